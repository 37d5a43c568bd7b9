"""Column functions: keys, calendar, physics, geodesy."""
