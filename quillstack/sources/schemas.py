"""Declared schemas; nothing is inferred."""

WORK = (
    "key string, kind string, title string, authors array<string>, year int, doi string, arxiv string, journal string, edition string, "
    "publisher string, series string, isbn array<string>, tags array<string>, files array<string>, abstract string"
)
SOURCE = "source_path string, fingerprint string"
PASSAGE = "id bigint, key string, work_title string, source_path string, chunk_index bigint, text string, headings array<string>, pages array<bigint>, raw_json string, embedding array<float>"
