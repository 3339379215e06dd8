"""Columns over titles, names and abstracts. All run inside whole-stage code generation but where stated."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title words that a work's key passes over (fixed values).
KEY_STOP_WORDS = ("a", "an", "the", "on", "of", "for", "in", "to", "and", "with")


def trim_space(c: Column) -> Column:
    """Strip white space of any script, which trim() doesn't."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(collapse_space(c), " "), lambda w: w != "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normal_key(c: Column) -> Column:
    """Trimmed and lower-cased, null when nothing is left: what duplicates are joined on."""
    return blank_to_null(F.lower(trim_space(c)))


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks."""
    pairs = [(a, b) for a, b in zip("áàâäãåāăąçćčďéèêëēėęěíìîïīįłñńňóòôöõøōőřśšşťţúùûüūůűýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorsssttuuuuuuuyyzzz", strict=True)]
    source, target = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return F.translate(c, source + source.upper(), target + target.upper())


def _one_mark() -> tuple[str, str]:
    """Characters that decompose to an ASCII letter and one mark, and small ones that fold to another, with these letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    found = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0].isascii() and d[0].isalpha() and unicodedata.combining(d[1])]
    small = map(chr, range(0xB5, 0x2000))
    found += [(c, c.casefold()) for c in small if len(c.casefold()) == 1 and c.casefold() != c.lower()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


MARKED, UNMARKED = _one_mark()
#: The combining marks that full-text tokens leave out (fixed values: bit masks of U+0300 to U+031F and U+0320 to U+0331).
_MARK_BITS = ((0x300, 0x08029FDF), (0x320, 0x000361F8))
LOOSE_MARKS = "".join(chr(start + i) for start, bits in _MARK_BITS for i in range(32) if bits >> i & 1)


def fold_marks(c: Column) -> Column:
    """Lower case, without loose marks, and Latin letters without a single mark of theirs, as the standard full-text tokens have them."""
    plain = F.lower(c)
    # ASCII has nothing to fold, and the pass costs more than all else
    return F.when(F.octet_length(c) == F.char_length(c), plain).otherwise(F.translate(plain, MARKED + LOOSE_MARKS, UNMARKED))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, dashes between; ß, æ and œ as two letters."""
    two = F.replace(F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    plain = strip_accents(two)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def migration_slug(c: Column) -> Column:
    """The older slug: letters outside ASCII are dropped, not spelt out."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\x00-\x7f]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_abstract(c: Column) -> Column:
    """Without tags, without a leading heading, white space collapsed."""
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    bare = F.regexp_replace(bare, r"(?iU)^\s*abstract\s*[.:]\s*", "")
    bare = F.regexp_replace(bare, r"(?sU)^\s*Abstract\s*([A-Z].*)$", "$1")
    return collapse_space(bare)


def _title_form(c: Column) -> Column:
    return collapse_space(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}\s]", ""))


def titles_match(a: Column, b: Column) -> Column:
    """Equal or one a beginning of the other, punctuation and case aside; false where one has nothing."""
    x, y = _title_form(a), _title_form(b)
    return F.coalesce((x != "") & (y != "") & (x.startswith(y) | y.startswith(x)), F.lit(False))


def split_authors(c: Column) -> Column:
    """By semicolons; else by commas if there are two or more; else by " and "; else one name."""
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    by = lambda sep: F.filter(F.transform(F.split(c, sep), trim_space), lambda x: x != "")
    return F.when(F.contains(c, F.lit(";")), by(";")).when(commas >= 2, by(",")).when(F.contains(c, F.lit(" and ")), by(" and ")).otherwise(F.array(trim_space(c)))


def family_given(c: Column) -> Column:
    """"Family, Given" from either order; a name with a comma loses trailing commas only."""
    trimmed = trim_space(c)
    parts = words(c)
    flipped = F.concat_ws(", ", F.try_element_at(parts, F.lit(-1)), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))
    return F.when(F.contains(trimmed, F.lit(",")), trim_space(F.regexp_replace(trimmed, ",+$", ""))).when(F.size(parts) > 1, flipped).otherwise(trimmed)


def given_family(c: Column) -> Column:
    """Flip at the first comma; a name without one stays."""
    family, given = trim_space(F.substring_index(c, ",", 1)), trim_space(F.regexp_replace(c, "^[^,]*,", ""))
    return F.when(F.contains(c, F.lit(",")), F.concat_ws(" ", given, family)).otherwise(c)


def key_surname(c: Column) -> Column:
    """What a key takes from a name: the text before the last comma; else the last word, or where that is an initial the first word that isn't."""
    parts = words(c)
    initial = lambda w: F.rlike(w, F.lit(r"^\p{IsAlphabetic}\.*$"))
    last = F.try_element_at(parts, F.lit(-1))
    full = F.filter(parts, lambda w: ~initial(w))
    by_words = F.when(F.size(parts) == 0, c).when((F.size(parts) > 1) & initial(last) & (F.size(full) > 0), F.get(full, F.lit(0))).otherwise(last)
    return F.when(F.contains(c, F.lit(",")), trim_space(F.regexp_extract(c, r"(?s)^(.*),", 1))).otherwise(by_words)


def sort_surname(c: Column) -> Column:
    """What sorting by author takes: before the first comma, else after the last space; missing is empty."""
    found = F.when(F.contains(c, F.lit(",")), trim_space(F.substring_index(c, ",", 1))).otherwise(F.substring_index(c, " ", -1))
    return F.coalesce(F.lower(found), F.lit(""))


def row_surname(c: Column) -> Column:
    """What a list row shows: before the last comma, else the last word."""
    return F.when(F.contains(c, F.lit(",")), trim_space(F.regexp_extract(c, r"(?s)^(.*),", 1))).otherwise(F.try_element_at(words(c), F.lit(-1)))


def work_key(authors: Column, year: Column, title: Column) -> Column:
    """surname-year-word as a slug; unknown, 0000 and untitled stand in."""
    content = F.filter(words(title), lambda w: ~F.lower(w).isin(*KEY_STOP_WORDS))
    return slug(
        F.concat_ws(
            "-",
            F.coalesce(key_surname(F.get(authors, F.lit(0))), F.lit("unknown")),
            F.coalesce(year.cast("string"), F.lit("0000")),
            F.coalesce(F.get(content, F.lit(0)), F.lit("untitled")),
        )
    )


def display_line(authors: Column, year: Column, title: Column) -> Column:
    """Author and whether there are others, (year), title; two spaces between what there is."""
    first = F.get(authors, F.lit(0))
    who = F.when(F.size(authors) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    return F.concat_ws("  ", blank_to_null(who), F.concat(F.lit("("), year.cast("string"), F.lit(")")), blank_to_null(title))


def author_preview(authors: Column) -> Column:
    """Up to three names; of more the first two, the last and how many are left out."""
    n = F.size(authors)
    rest = F.concat(F.lit("+"), (n - 3).cast("string"), F.when(n - 3 == 1, F.lit(" author")).otherwise(F.lit(" authors")))
    return F.when(n <= 3, F.array_join(authors, " · ")).otherwise(
        F.concat_ws(" · ", F.get(authors, F.lit(0)), F.get(authors, F.lit(1)), F.try_element_at(authors, F.lit(-1)), rest)
    )


def external_url(doi: Column, arxiv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))


def page_location(pages: Column) -> Column:
    """p. n, pp. a, b or null."""
    shown = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) == 1, F.concat(F.lit("p. "), shown)).when(F.size(pages) > 1, F.concat(F.lit("pp. "), shown))


def list_row(key: Column, authors: Column, year: Column, title: Column) -> Column:
    """Year or blanks, the first author's surname cut to 12 bytes and right-aligned, the title."""
    name = F.coalesce(row_surname(F.get(authors, F.lit(0))), F.lit(""))
    return F.concat_ws("  ", F.lpad(F.coalesce(year.cast("string"), F.lit("")), 4, " "), F.lpad(truncate(name, 12), 12, " "), title)


def detail_view(w: dict[str, Column]) -> Column:
    """The lines of a work's detail view, by the columns of a work: title, what and when, authors, for books where they appeared, addresses, tags, abstract, with blank lines between."""
    none = F.array().cast("array<string>")
    lines = lambda condition, *of: F.when(condition, F.array(*(F.lit(x) if isinstance(x, str) else x for x in of))).otherwise(none)
    book, has = w["kind"] == "book", lambda name: w[name].isNotNull()
    listed = lambda name: F.coalesce(F.size(w[name]) > 0, F.lit(False))
    when = F.concat_ws(" · ", w["year"].cast("string"), w["journal"], F.when(book, "book"), F.when(book, F.concat(w["edition"], F.lit(" ed."))))
    where = F.concat_ws(" · ", w["publisher"], w["series"], F.when(listed("isbn"), F.concat(F.lit("ISBN "), F.array_join(w["isbn"], ", "))))
    addressed = has("doi") | has("arxiv")
    parts = (
        F.array(F.lit(""), w["title"]),
        lines(has("year") | has("journal") | book, "", when),
        F.array(F.lit("")),
        lines(listed("authors"), author_preview(w["authors"]), ""),
        lines(book & (has("publisher") | has("series") | listed("isbn")), where, ""),
        lines(has("doi"), F.concat(F.lit("doi   "), w["doi"])),
        lines(has("arxiv"), F.concat(F.lit("arxiv "), w["arxiv"])),
        lines(listed("tags") & addressed, ""),
        lines(listed("tags"), F.concat(F.lit("tags  "), F.array_join(w["tags"], ", "))),
        lines(has("abstract"), "", w["abstract"]),
    )
    return F.array_join(F.concat(*parts), "\n")


def fill_template(template: str, **columns: Column) -> Column:
    """A template's {name} places filled in."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def preview(c: Column, most: int) -> Column:
    """White space collapsed, cut to most characters with an ellipsis as the last."""
    flat = collapse_space(c)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def truncate(c: Column, most: int) -> Column:
    """The first so many bytes of UTF-8, less what a cut character leaves."""
    cut = F.substring(c.cast("binary"), 1, most)
    whole = [F.when(F.is_valid_utf8(F.substring(cut, 1, most - n).cast("string")), F.substring(cut, 1, most - n).cast("string")) for n in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*whole))


def truncate_ellipsis(c: Column, most: int) -> Column:
    """A text of more bytes cut to one byte less than most, and an ellipsis; nothing is cut to under two bytes."""
    return c if most < 2 else F.when(F.octet_length(c) <= most, c).otherwise(F.concat(truncate(c, most - 1), F.lit("…")))


#: What a message about a failed search says, by what the error contains (fixed values); else the error itself follows "Semantic search: ".
SEARCH_ERRORS = (
    ("Semantic index is not initialized", "Semantic index not built.\nRun `quillstack semantic-index` first."),
    ("Semantic index is empty", "Semantic index not built.\nRun `quillstack semantic-index` first."),
    ("Semantic index uses model", "Semantic index was built with an older model; run `quillstack semantic-index`"),
)


def search_error(c: Column) -> Column:
    """A message for a reader about a failed search; null stays null."""
    out = F.concat(F.lit("Semantic search: "), c)
    for part, message in reversed(SEARCH_ERRORS):
        out = F.when(F.contains(c, F.lit(part)), F.lit(message)).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """From 1 MiB on as x.y MB, else whole KB, 1 at least. A half of a tenth goes to the even one, as C's printf has it."""
    kb = F.greatest(F.ceil(n / 1024), F.lit(1)).cast("string")
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", F.bround(n / float(1 << 20), 1)), F.lit(" MB"))).otherwise(F.concat(kb, F.lit(" KB")))


def progress_line(done: Column, total: Column, seconds: Column, width: int = 20) -> Column:
    """A bar of so many characters, the percentage, done/total and minutes:seconds; at least one in all, and no more done than that."""
    total = F.greatest(total, F.lit(1))
    done = F.least(done, total)
    filled = F.floor(done * width / total).cast("int")
    bar = F.concat(F.repeat(F.lit("="), filled), F.repeat(F.lit(" "), F.lit(width) - filled))
    return F.format_string("Embedding passages [%s] %3d%% %d/%d %02d:%02d", bar, F.floor(done * 100 / total), done, total, F.floor(seconds / 60), F.pmod(seconds, F.lit(60)))


def _word_pieces(word: Column, width: int) -> Column:
    """A word of more than width characters in pieces of at most width bytes, but for a rest of at most width characters, which stays whole."""

    def grow(s: Column, ch: Column) -> Column:
        joined = F.concat(s["piece"], ch)
        fits = (s["rest"] <= width) | (s["piece"] == "") | (F.octet_length(joined) <= width)
        return F.when(fits, F.struct(s["done"].alias("done"), joined.alias("piece"), s["rest"].alias("rest"))).otherwise(
            F.struct(F.concat(s["done"], F.array(s["piece"])).alias("done"), ch.alias("piece"), (s["rest"] - F.length(s["piece"])).alias("rest"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("piece"), F.length(word).alias("rest"))
    broken = F.aggregate(F.split(word, ""), start, grow, lambda s: F.concat(s["done"], F.array(s["piece"])))
    return F.when(F.length(word) <= width, F.array(word)).otherwise(broken)


def wrap_words(c: Column, width: int) -> Column:
    """Lines of at most width characters: words one blank apart, longer ones broken on lines of their own; no width is one line."""
    if width <= 0:
        return F.array(c)

    def place(s: Column, pieces: Column) -> Column:
        word, line = F.try_element_at(pieces, F.lit(-1)), s["line"]
        before = F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(line))
        joined = F.concat_ws(" ", line, word)
        state = lambda lines, line: F.struct(lines.alias("lines"), line.alias("line"))
        return (
            F.when(F.size(pieces) > 1, state(F.concat(s["lines"], before, F.slice(pieces, 1, F.size(pieces) - 1)), word))
            .when(line == "", state(s["lines"], word))
            .when(F.length(joined) <= width, state(s["lines"], joined))
            .otherwise(state(F.concat(s["lines"], before), word))
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(F.transform(words(c), lambda w: _word_pieces(w, width)), start, place, lambda s: F.concat(s["lines"], F.array(s["line"])))


def bounded_lines(text: Column, width: int, most: int) -> Column:
    """At most so many wrapped lines; the last one ends in an ellipsis where more follow."""
    lines = wrap_words(text, width)
    cut = F.concat(F.slice(lines, 1, most - 1), F.array(F.concat(F.left(F.get(lines, F.lit(most - 1)), F.lit(width - 1)), F.lit("…"))))
    return F.when(F.size(lines) > most, cut).otherwise(lines)
