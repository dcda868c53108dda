"""lexmill: build, link and search large collections of public legal texts on Spark."""
