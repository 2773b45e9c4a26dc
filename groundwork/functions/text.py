"""Scalar text functions: Column in, Column out, all built-in functions inside the JVM.

White space is Unicode's; ``(?U)`` makes Java's classes Unicode-aware. Null stays null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions import lexicon as L


def either(phrases: Sequence[str], flags: str = "") -> str:
    """One pattern for any of several literal phrases."""
    quoted = ["".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in p) for p in phrases]
    return (f"(?{flags})" if flags else "") + "(?:" + "|".join(quoted) + ")"


#: White space as ``(?U)\\s`` has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Blanks alone (Unicode's Zs), which is what ``trim`` takes off in DuckDB: no tabs, no line ends.
BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(WHITE))


def strip_blanks(t: Column) -> Column:
    return F.btrim(t, F.lit(BLANKS))


def lines(t: Column) -> Column:
    return F.split(t, "\n")


def keep_lines(t: Column, good) -> Column:
    return F.array_join(F.filter(lines(t), good), "\n")


def printable(t: Column) -> Column:
    """Without control, format, unassigned and separator characters, but for space, line feed and tab."""
    return F.regexp_replace(t, r"[\p{C}\p{Z}&&[^ \n\t]]", "")


def join_hyphenated(t: Column) -> Column:
    """Words that a hyphen breaks over a line end are joined."""
    # Most texts have no hyphen at a line end; the full pattern walks every word.
    return F.when(t.rlike(r"(?U)-\s*\n"), F.regexp_replace(t, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")).otherwise(t)


def normal_space(t: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, three or more line feeds to two, then each line stripped."""
    runs = F.regexp_replace(F.regexp_replace(F.translate(t, "\t", " "), " +", " "), "\n{3,}", "\n\n")
    return F.array_join(F.transform(lines(runs), strip), "\n")


def without_page_numbers(t: Column) -> Column:
    return keep_lines(t, lambda x: ~(strip(x).rlike(r"(?U)^[\d\s\-]+$") | strip(x).rlike(r"(?iU)^Page\s+\d+$")))


def without_contacts(t: Column) -> Column:
    """Without lines that hold an address, a link or a DOI."""
    return keep_lines(t, lambda x: ~(x.rlike(r"\S+@\S+\.\S+") | x.rlike(r"https?://\S+") | x.rlike("(?i)doi:")))


def without_contents(t: Column) -> Column:
    """Without lines of a table of contents, captions, and lines of fewer than five words."""

    def good(x: Column) -> Column:
        s = strip(x)
        return ~(s.rlike(r"\.{5,}") | s.rlike(r"(?U)^(Box|Figure|Table)\s+\d") | F.lower(s).startswith("list of") | (word_count(s) < 5))

    return keep_lines(t, good)


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def paragraphs(t: Column) -> Column:
    """Split at blank lines and before lines that begin with A to Z; stripped, without empty ones."""
    return F.filter(F.transform(F.split(t, r"(?U)\n\s*\n|\n(?=[A-Z])"), strip), lambda p: p != "")


def clean_lines(t: Column) -> Column:
    """All cleaning steps in order, before the split into paragraphs."""
    return without_contents(without_contacts(without_page_numbers(normal_space(join_hyphenated(printable(t))))))


def has_any(t: Column, phrases: Sequence[str]) -> Column:
    """Whether the text holds one of the phrases anywhere, in any case, also inside words."""
    return holds_any(F.lower(t), phrases)


def holds_any(low: Column, phrases: Sequence[str]) -> Column:
    """has_any of a text that is in lower case already."""
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


def citations(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"(?U)\([A-Z][a-z]+(?:\s+et\s+al\.)?,\s*\d{4}\)")) + F.regexp_count(t, F.lit(r"\[\d+\]"))


def has_quantity(t: Column) -> Column:
    return t.rlike(r"(?U)\d") & t.rlike("(?iU)" + "|".join(f"(?:{p})" for p in L.QUANTITIES))


def dedup_key(t: Column) -> Column:
    """Stripped, lower case, white space collapsed."""
    return F.regexp_replace(F.lower(strip(t)), r"(?U)\s+", " ")


def label(t: Column) -> Column:
    """Lower case; white space and hyphens to one underscore; nothing but a-z, 0-9 and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(t)), r"(?U)[\s\-]+", "_"), "[^a-z0-9_]", "")


def from_first_capital(t: Column) -> Column:
    """Cut to the first capital that begins a word, if it comes early (after the start, before place 60)."""
    lead = F.regexp_extract(t, r"(?sU)^(.*?(?<!\w))[A-Z]", 1)
    found = t.rlike(r"(?U)(?<!\w)[A-Z]")
    at = F.length(lead)
    return F.when(found & (at > 0) & (at < 60), F.substring(t, at + 1, F.length(t))).otherwise(t)


def keywords(t: Column, stop: Sequence[str] = L.STOP) -> Column:
    """Words of more than three letters that are no stop words; punctuation is deleted, not spaced."""
    plain = F.lower(F.regexp_replace(t, r"(?U)[^a-zA-Z0-9\s]", ""))
    return F.filter(words(plain), lambda w: (F.length(w) > 3) & ~w.isin(*stop))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def relation(t: Column) -> Column:
    """Upper case with underscores; null and empty are NONE."""
    return F.coalesce(F.nullif(F.translate(F.upper(F.trim(t)), " -", "__"), F.lit("")), F.lit("NONE"))


def meaningful(t: Column) -> Column:
    """Whether a text can name something: not short, not a number, a year or a quantity."""
    s = strip(t)
    numeric = s.rlike(r"(?U)^[\d\s,\.%\-]+$") | s.rlike(r"^\d{4}$") | s.rlike(r"(?iU)^\d[\d\s\.,]*(per\s+cent|million|billion|trillion|%)")
    return (F.length(s) >= 3) & ~numeric


def complete(t: Column) -> Column:
    """Whether the text ends as a sentence does; null and empty do not."""
    return F.coalesce(strip(t).rlike(r"""[.!?]["')\]]*\s*$"""), F.lit(False))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(strip(t), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def limited(t: Column, most: int = 30) -> Column:
    """Whole sentences up to the one that reaches the number of words."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(acc["n"] >= most, acc).otherwise(F.struct((acc["n"] + word_count(s)).alias("n"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.array_join(F.aggregate(sentences(t), start, step, lambda acc: acc["out"]), " ")


def _last(t: Column, mark: str) -> Column:
    """Place of the last occurrence, from 0; -1 if there is none."""
    back = F.locate(mark[::-1], F.reverse(t))
    return F.when(back > 0, F.length(t) - back - len(mark) + 1).otherwise(-1)


def to_sentence_end(t: Column) -> Column:
    """Nothing after the last sentence end; else cut at a clause, else after 28 words, with a full stop."""
    s = strip(t)
    head = F.regexp_extract(s, r"(?s)^(.*[.!?])", 1)
    late = [F.when(_last(s, m) >= L.CLAUSE_FROM, _last(s, m)).otherwise(-1) for m in L.CLAUSE_WORDS]
    cut = F.greatest(*[_last(s, m) for m in L.CLAUSE_MARKS], *late)
    bare = lambda x: F.regexp_replace(x, r"[ ,;:\-]+$", "")
    clause = bare(F.substring(s, F.lit(1), cut))
    short = F.when(word_count(s) > L.SENTENCE_MOST, bare(F.array_join(F.slice(words(s), 1, L.SENTENCE_MOST), " "))).otherwise(bare(s))
    return F.when(s == "", s).when(s.rlike(r"[.!?]\z"), s).when(strip(head) != "", strip(head)).when((cut >= L.CLAUSE_FROM) & (word_count(clause) >= L.CLAUSE_LEAST), F.concat(clause, F.lit("."))).otherwise(F.concat(short, F.lit(".")))


def cited(t: Column) -> Column:
    """Distinct citation tags, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(TEXT:\d+|KG:[^\]]+)\]"), F.lit(1)))


def _each(t: Column, patterns: Sequence[str], prefix: str = "(?iU)", by: str = "") -> Column:
    for p in patterns:
        t = F.regexp_replace(t, prefix + p, by)
    return t


def _unique_sentences(s: Column) -> Column:
    """Sentences without instructions, the first of equal ones (in any case)."""
    leak = "(?iU)" + "|".join(f"(?:{p})" for p in L.LEAK_SENTENCES)
    kept = F.filter(s, lambda x: ~x.rlike(leak))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def postprocessed(t: Column) -> Column:
    """An answer without leaked instructions, repeated sentences and inline citations, which form a last line."""
    c = strip(F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\[(TEXT:\d+|KG:[^\]]+)\]", ""), r"(?U)\s+", " "))
    for _ in range(3):
        c = strip(_each(c, L.LEAKS_AT_START))
    c = _each(c, (*L.LEAKS_INLINE, *L.HEADINGS))
    c = strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s*##+\s*", " "), r"(?U)\s+", " "))
    c = F.regexp_replace(c, "(?iU)" + L.LEAKED_WRITE, "$1 ")
    c = _each(c, L.LEAKED_BULLETS)
    c = strip(F.regexp_replace(c, "^[- ]+", ""))
    concise = to_sentence_end(F.array_join(_unique_sentences(sentences(c)), " "))
    return F.when(t.isNull() | (t == ""), t).when(F.size(cited(t)) > 0, F.concat(concise, F.lit("\nSources: "), F.array_join(cited(t), ", "))).otherwise(concise)


def sanitized(t: Column) -> Column:
    """An answer without leaked prompt text: wrappers up to three times, then what stands inside."""
    c = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    for _ in range(3):
        c = strip(_each(c, L.SANITIZE_AT_START))
    c = F.regexp_replace(c, "(?iU)" + L.LEAKED_WRITE, "$1 ")
    c = _each(c, L.SANITIZE_INLINE)
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s*##+\s*", " "), r"(?U)\s+", " "))


def without_log(t: Column) -> Column:
    """Lines that are no log lines, joined; a text that says that nothing was found becomes the one message for it."""
    kept = F.filter(F.transform(lines(t), strip), lambda x: (x != "") & ~x.rlike(either(L.LOG_PHRASES)))
    joined = F.array_join(kept, " ")
    return F.when(F.lower(joined).rlike(either(L.NO_INFO_PHRASES)), F.lit(L.NO_INFO)).otherwise(joined)


def without_filler(t: Column) -> Column:
    """Without opening phrases, first letter upper; an answer that gives up becomes the message for it."""
    bare = _each(t, [f"^{either([p])}\\s*" for p in L.PREFIXES])
    bare = F.when(bare != t, strip(bare)).otherwise(t)
    c = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(t)))
    return F.when(F.lower(t).rlike("|".join(L.GIVES_UP)), F.lit(L.NO_INFO)).otherwise(c)


def after(t: Column, mark: str = "Answer:") -> Column:
    """What follows the last mark, stripped."""
    return strip(F.substring_index(t, mark, -1))


def json_list(t: Column, element: str, keys: Sequence[str] = L.LIST_KEYS) -> Column:
    """The list that a model answered as JSON, in code fences or not: itself, or under one of the keys; else null."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(t), r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))
    found = [F.get_json_object(bare, f"$.{k}") for k in keys]
    body = F.when(bare.startswith("["), bare).otherwise(F.coalesce(*found))
    return F.from_json(body, f"array<{element}>")


def fallback_labels(t: Column, most: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(t, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), F.lit(0)), 1, most)


def human_bytes(n: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f PB", n / float(1024**5))
    for k in reversed(range(len(units))):
        out = F.when(n < float(1024 ** (k + 1)), F.format_string(f"%.1f {units[k]}", n / float(1024**k))).otherwise(out)
    return out


def spec_cleaned(t: Column) -> Column:
    """The pattern that a model wrote, out of its fences: from MATCH to the first limit, plain quotes, no genitives; else empty."""
    bare = F.regexp_replace(t, r"(?is)```(?:cypher)?(.*?)```", "$1")
    found = F.regexp_extract(bare, r"(?i)(MATCH[\s\S]*?LIMIT\s+\d+)", 1)
    return strip(F.regexp_replace(F.regexp_replace(found, "[“”]", "'"), r"(?U)'s\b", ""))


def spec_allowed(t: Column, relations: Sequence[str]) -> Column:
    """Whether a written graph pattern is long enough, matches and returns, and names only entities and known relations."""
    named = F.regexp_extract_all(t, F.lit(r":\s*`?([A-Za-z_]+)`?"), F.lit(1))
    known = F.array(*[F.lit(x) for x in ("Entity", *relations)])
    return F.coalesce((F.length(strip(t)) >= 10) & F.upper(t).contains("MATCH") & F.upper(t).contains("RETURN") & (word_count(t) >= 4) & (F.size(F.array_except(named, known)) == 0), F.lit(False))


def lexical(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; 0 if either has none."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def tag(t: Column, variant: str = "partial_first") -> Column:
    """A reviewer's word as correct, partial, hallucinated or unknown, by one of three rules.

    exact: correct and hallucinated only as the whole text, partial anywhere. partial_first: partial, then correct, then hallucinated, anywhere. correct_first:
    correct without partial, then hallucinated, then partial.
    """
    s = F.coalesce(F.lower(strip(t)), F.lit(""))
    correct, partial, wrong = s.contains("correct"), s.contains("partial"), s.contains("hallu")
    if variant == "exact":
        return F.when(s == "correct", "correct").when(s == "hallucinated", "hallucinated").when(partial, "partial").otherwise("unknown")
    if variant == "partial_first":
        return F.when(partial, "partial").when(correct, "correct").when(wrong, "hallucinated").otherwise("unknown")
    return F.when(correct & ~partial, "correct").when(wrong, "hallucinated").when(partial, "partial").otherwise("unknown")
