"""Column functions: text analysis, URLs, dates, codecs, HTML and vector arithmetic."""
