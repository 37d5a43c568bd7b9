"""Cases that an operator once left out."""

from gridloom.llm import html, linededup, pii


def test_short_lines(spark):
    rows = [
        (1, "Share this article\n\nAll rights reserved.\n文章的第一段没有空格"),
        (2, "Share  this article\n\nShare this page\n文章的第一段没有空格\n文章的第二段没有空格"),
        (3, "one two three four five\nsix seven eight nine"),
        (4, "one two three four 5\nsix seven eight 9\none two three four five six"),
        (5, "\n \n"),
    ]
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (4, ""), 2: (5, "0,3"), 3: (2, ""), 4: (3, "0,1,2"), 5: (3, "")}


def test_terms_far_from_what_they_reveal(spark):
    filler = lambda k: " ".join(f"a{'bcdefghij'[(k * 7 + i) % 9]}{'bcdefghij'[i % 9]}" for i in range(60))
    rows = [(k, f"Zaphodia wrote {'xyz' * (k + 2)}\n{filler(k)}\nmail neo@matrix.org now\n{filler(k + 1)} zaphodia") for k in range(3)]
    rows += [(10 + k, f"plain text of number {k} wrote mail") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(docs).collect()}
    for k, text in rows[:3]:
        assert {"term:0:8", f"term:{len(text) - 8}:{len(text)}"} <= set(got[k])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert not any("zaphodia" in clean[k].lower() or "neo@" in clean[k] for k in range(3))
    assert all(clean[k] == text for k, text in rows[3:])


def test_page_with_an_article_in_an_article():
    body = "".join(f"<p>Paragraph {k} of the body with a good many words in it.</p>" for k in range(9))
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>The lead.</p><div class='entry-content'>{body}</div><p>A correction.</p></article><footer>c</footer></body>"
    for tag in html.TAG_WEIGHTS:
        text = html.main_text(page, html.Weights(tag, -1.0)).split("\n")
        assert (text[:2], len(text), text[-1]) == (["Title", "The lead."], 12, "A correction.")


def test_region_beyond_its_element():
    body = "".join(f"<p>Paragraph {k} of the body with a good many words in it.</p>" for k in range(9))
    page = "<body>{0}<p>A last section with quite a few words of its own.</p></body>"
    for name in ("entry-content", "plain"):
        text = html.main_text(page.format(f"<div class='{name}'>{body}</div>"), html.Weights(-0.5, -1.0))
        assert text.endswith("Paragraph 8 of the body with a good many words in it.\nA last section with quite a few words of its own.")
