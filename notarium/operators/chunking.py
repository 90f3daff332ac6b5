"""Chunking of text, Markdown, pages and issue threads, as column expressions.

A document becomes an array of chunks within its row: no shuffle, no Python.  Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_noise, trim_all

MAX_CHUNK, MIN_CHUNK, OVERLAP = 6000, 200, 800
_STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, and written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(parts: Column, begin: Column, many: Column, separator: str) -> Column:
    """`many` parts from `begin` (from 0) as one text.  A slice would read all parts each time."""
    return F.when(many > 0, F.array_join(F.transform(F.sequence(begin, begin + many - 1), lambda i: F.get(parts, i)), separator)).otherwise(F.lit(""))


def hard_split(text: Column, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """Pieces of `size` characters that overlap; when they would not advance, only the first.

    The text is cut once, into blocks of what each piece adds; a piece is its block and the begin of what follows.
    """
    step = size - overlap
    length = F.char_length(text)
    if step <= 0:
        return F.array(F.substring(text, 1, size))
    last = F.ceil((length - size) / step).cast("int")
    ahead = -(-overlap // step)

    def pieces(blocks: Column) -> Column:
        follows = lambda i: F.substring(F.array_join(F.slice(blocks, i + 2, F.lit(ahead)), ""), 1, overlap)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.get(blocks, i), follows(i)))

    return F.when(length <= size, F.array(text)).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), pieces))


def _emit(content: Column, least: int) -> Column:
    """The chunks of one content: split if too long, none if shorter than `least`, else itself."""

    def chunks(c: Column) -> Column:
        whole = F.array(c) if not least else F.when(F.char_length(trim_all(c)) >= least, F.array(c)).otherwise(F.array().cast(_STRINGS))
        return F.when(F.char_length(c) > MAX_CHUNK, hard_split(c)).otherwise(whole)

    return let(content, chunks)


def pack(paragraphs: Column, prefix: Column, *, first_only: bool = False, least: int = 0) -> Column:
    """Greedy packing of paragraphs, none of them blank, into chunks of at most MAX_CHUNK with the prefix.

    first_only: the prefix stands before the first chunk that is emitted; otherwise before each.
    least: shorter chunks are left out, which asks for trimmed paragraphs and a prefix that begins with no blank.

    A fold over the lengths alone finds the chunks' borders; the texts are joined once, afterwards.
    """

    def cuts(lengths: Column, before: Column) -> Column:
        here = (lambda acc: F.when(acc["said"], 0).otherwise(before)) if first_only else (lambda acc: before)
        emitted = lambda acc: here(acc) + acc["n"] >= least
        own = lambda acc: F.array(F.struct(acc["begin"].alias("begin"), (acc["i"] - acc["begin"]).alias("many"), (~acc["said"] if first_only else F.lit(True)).alias("headed")))
        out = lambda acc: F.when(emitted(acc), F.concat(acc["o"], own(acc))).otherwise(acc["o"])

        def step(acc: Column, n: Column) -> Column:
            grown = acc["n"] + 2 + n
            state = lambda o, begin, n, said: F.struct(o.alias("o"), begin.alias("begin"), (acc["i"] + 1).alias("i"), n.alias("n"), said.alias("said"))
            return (
                F.when(acc["n"] == 0, state(acc["o"], acc["begin"], n, acc["said"]))
                .when(here(acc) + grown > MAX_CHUNK, state(out(acc), acc["i"], n, acc["said"] | emitted(acc)))
                .otherwise(state(acc["o"], acc["begin"], grown, acc["said"]))
            )

        none = F.array().cast("array<struct<begin:int,many:int,headed:boolean>>")
        zero = F.struct(none.alias("o"), F.lit(0).alias("begin"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("said"))
        return F.aggregate(lengths, zero, step, lambda acc: F.when(acc["n"] == 0, acc["o"]).otherwise(out(acc)))

    def chunks(parts: Column, prefix: Column) -> Column:
        text = lambda c: F.concat(F.when(c["headed"], prefix).otherwise(F.lit("")), joined(parts, c["begin"], c["many"], "\n\n"))
        borders = let(F.char_length(prefix), lambda n: cuts(F.transform(parts, F.char_length), n))
        return F.flatten(F.transform(borders, lambda c: _emit(text(c), 0)))

    return let(F.coalesce(prefix, F.lit("")), lambda p: let(paragraphs, lambda parts: chunks(parts, p)))


def paragraphs(text: Column, trimmed: bool = False) -> Column:
    parts = F.split(text, "\n\n")
    return F.filter(F.transform(parts, trim_all), lambda p: p != "") if trimmed else F.filter(parts, lambda p: trim_all(p) != "")


def text_chunks(content: Column, file_name: Column) -> Column:
    """Chunks of plain text; the source is named before the first."""
    return pack(paragraphs(content, trimmed=True), F.concat(F.lit("[Source: "), file_name, F.lit("]\n\n")), first_only=True, least=MIN_CHUNK)


def _whole_or_packed(prefix: Column, text: Column) -> Column:
    return F.when(F.char_length(prefix) + F.char_length(text) <= MAX_CHUNK, F.array(F.concat(prefix, text))).otherwise(pack(paragraphs(text), prefix))


# -- Markdown -------------------------------------------------------------------------------------------------------

_HEADING = r"\A(#{1,3})(?U:\s|\x{FEFF})+([^\n\r\x{2028}\x{2029}]+)\z"


def front_matter_lines(lines: Column) -> Column:
    """How many lines at the top are front matter (0 if none): --- up to the next exact ---."""
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "---")
    return F.when((trim_all(F.get(lines, F.lit(0))) == "---") & (end > 0), end + 1).otherwise(F.lit(0)).cast("int")


def markdown_sections(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with front_matter and sections: an array of (heading, text), headings as breadcrumbs, texts trimmed.

    A heading ends those of its own level and of lower ones; levels may be skipped.
    """
    passed = docs.columns
    lines = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    fronted = lines.withColumn("_n", front_matter_lines(F.col("_lines")))
    body = fronted.select(
        *passed, F.when(F.col("_n") > 0, F.array_join(F.slice("_lines", F.lit(1), F.col("_n")), "\n")).otherwise(F.lit("")).alias("front_matter"),
        F.slice("_lines", F.col("_n") + 1, F.size("_lines")).alias("_l"),
    )
    marked = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: F.startswith(h["x"], F.lit("#")))
    heads = F.filter(F.transform(marked, lambda h: F.struct(h["i"].alias("i"), F.char_length(F.regexp_extract(h["x"], _HEADING, 1)).alias("level"), trim_all(F.regexp_extract(h["x"], _HEADING, 2)).alias("t"))), lambda h: h["level"] > 0)
    placed = body.withColumn("_h", heads).withColumn("_c", _breadcrumbs(F.col("_h")))
    begin = F.concat(F.array(F.lit(0)), F.transform("_h", lambda h: h["i"] + 1))
    end = F.concat(F.transform("_h", lambda h: h["i"]), F.array(F.size("_l")))
    spans = F.arrays_zip(begin.alias("begin"), end.alias("end"), F.concat(F.array(F.lit("")), "_c").alias("heading"))
    cut = placed.select(*passed, "front_matter", "_l", spans.alias("_s"))
    section = lambda s: F.struct(s["heading"].alias("heading"), trim_all(joined(F.col("_l"), s["begin"], s["end"] - s["begin"], "\n")).alias("text"))
    return cut.select(*passed, "front_matter", F.transform("_s", section).alias("sections"))


def _breadcrumbs(heads: Column) -> Column:
    """The breadcrumb at each heading (i, level, t): a heading ends those of its level and below."""
    none = F.lit(None).cast("string")

    def step(acc: Column, h: Column) -> Column:
        own = F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["t"])
        kept = [F.when(h["level"] == n, own).when(h["level"] > n, acc[f"h{n}"]) for n in (1, 2, 3)]
        crumb = F.concat_ws(" > ", *kept)
        return F.struct(F.concat(acc["out"], F.array(crumb)).alias("out"), *[k.alias(f"h{n}") for n, k in zip((1, 2, 3), kept, strict=True)])

    zero = F.struct(F.array().cast(_STRINGS).alias("out"), none.alias("h1"), none.alias("h2"), none.alias("h3"))
    return F.aggregate(heads, zero, step, lambda acc: acc["out"])


def markdown_chunks(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with chunks: an array of (content, heading).  Sections under MIN_CHUNK are dropped; the first kept one has the front matter before it."""
    cut = markdown_sections(docs, text)
    kept = cut.withColumn("sections", F.filter("sections", lambda s: F.char_length(s["text"]) >= MIN_CHUNK))

    def chunks(s: Column, i: Column) -> Column:
        line = lambda x: F.when(x != "", F.concat(x, F.lit("\n\n"))).otherwise(F.lit(""))
        prefix = F.concat(F.when(i == 0, line(F.col("front_matter"))).otherwise(F.lit("")), line(s["heading"]))
        parts = let(prefix, lambda p: _whole_or_packed(p, s["text"]))
        return F.transform(parts, lambda c: F.struct(c.alias("content"), F.nullif(s["heading"], F.lit("")).alias("heading")))

    return kept.withColumn("chunks", F.flatten(F.transform("sections", chunks))).drop("sections", "front_matter")


# -- Pages ----------------------------------------------------------------------------------------------------------

# What a page ends in when its last sentence is complete.
_ENDS = list(".!?:;)]\"'")


def merged_pages(pages: Column) -> Column:
    """Pages joined while the text so far ends in mid-sentence or is short: an array of (text, first, last).

    A text is its pages, trimmed, without blank ones; so lengths and ends of pages tell where texts end.
    """
    kind = "array<struct<first:int,last:int>>"

    def merged(pages: Column) -> Column:
        seen = F.transform(pages, lambda p: F.struct(F.char_length(p).alias("n"), (~F.substring(p, -1, 1).isin(_ENDS)).alias("open")))

        def step(acc: Column, x: Column) -> Column:
            state = lambda o, n, open_, first: F.struct(o.alias("o"), n.alias("n"), open_.alias("open"), first.alias("first"), (acc["i"] + 1).alias("i"))
            text = F.array(F.struct(acc["first"].alias("first"), acc["i"].alias("last")))
            grown = F.when(acc["n"] == 0, x["n"]).otherwise(acc["n"] + 2 + x["n"])
            return (
                F.when((acc["n"] >= MIN_CHUNK) & ~acc["open"], state(F.concat(acc["o"], text), x["n"], x["open"], acc["i"] + 1))
                .when(x["n"] == 0, state(acc["o"], acc["n"], acc["open"], acc["first"]))
                .otherwise(state(acc["o"], grown, x["open"], acc["first"]))
            )

        zero = F.struct(F.array().cast(kind).alias("o"), F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit(1).alias("first"), F.lit(0).alias("i"))
        spans = F.aggregate(seen, zero, step, lambda acc: F.when(acc["i"] == 0, acc["o"]).otherwise(F.concat(acc["o"], F.array(F.struct(acc["first"].alias("first"), acc["i"].alias("last"))))))
        text = lambda s: F.array_join(F.filter(F.slice(pages, s["first"], s["last"] - s["first"] + 1), lambda p: p != ""), "\n\n")
        return F.transform(spans, lambda s: F.struct(text(s).alias("text"), s["first"].alias("first"), s["last"].alias("last")))

    return let(F.transform(pages, lambda p: F.coalesce(trim_all(p), F.lit(""))), merged)


def page_chunks(pages: Column) -> Column:
    """An array of (content, page, page_end) from pages of text; pages count from 0."""
    kept = F.filter(merged_pages(pages), lambda m: F.char_length(m["text"]) >= MIN_CHUNK)

    def chunks(m: Column) -> Column:
        first, last = m["first"].cast("string"), m["last"].cast("string")
        label = F.when(m["first"] == m["last"], F.concat(F.lit("[Page "), first, F.lit("]\n\n"))).otherwise(F.concat(F.lit("[Pages "), first, F.lit("-"), last, F.lit("]\n\n")))
        parts = let(label, lambda p: _whole_or_packed(p, m["text"]))
        return F.transform(parts, lambda c: F.struct(c.alias("content"), (m["first"] - 1).alias("page"), (m["last"] - 1).alias("page_end")))

    return F.flatten(F.transform(kept, chunks))


# -- Issues ---------------------------------------------------------------------------------------------------------


def _who(c: Column) -> Column:
    return F.concat(F.lit("@"), c["author"]["login"], F.lit(" ("), F.substring(c["createdAt"], 1, 10), F.lit("):"))


def issue_prefix(number: Column, title: Column) -> Column:
    return F.concat(F.lit("[Issue #"), number.cast("string"), F.lit(": "), title, F.lit("]"))


def issue_chunks(number: Column, title: Column, body: Column, comments: Column) -> Column:
    """Chunks of an issue: its body, long comments alone, runs of short comments together; noise is left out."""
    prefix = issue_prefix(number, title)
    real = F.filter(comments, lambda c: ~is_noise(c["body"]))
    alone = F.transform(real, lambda c: F.struct(
        F.concat(prefix, F.lit(" Comment by "), _who(c), F.lit("\n\n"), trim_all(c["body"])).alias("full"), F.concat(_who(c), F.lit("\n"), trim_all(c["body"])).alias("line"),
    ))

    def groups(c: Column) -> Column:
        short = lambda i: F.char_length(F.get(c, i)["full"]) < MIN_CHUNK
        begins = F.filter(F.transform(c, lambda x, i: i), lambda i: (i == 0) | ~(short(i) & F.coalesce(short(i - 1), F.lit(False))))

        def text(begins: Column) -> Column:
            talk = lambda i, k: F.array_join(F.transform(F.slice(c, i + 1, F.coalesce(F.get(begins, k + 1), F.size(c)) - i), lambda x: x["line"]), "\n\n")
            return F.transform(begins, lambda i, k: F.when(short(i), F.concat(prefix, F.lit(" Conversation:\n\n"), talk(i, k))).otherwise(F.get(c, i)["full"]))

        return let(begins, text)

    root = trim_all(F.concat(prefix, F.lit("\n\n"), F.coalesce(body, F.lit(""))))
    return F.concat(_emit(root, MIN_CHUNK), F.flatten(F.transform(let(alone, groups), lambda g: _emit(g, MIN_CHUNK))))


def issue_hash(body: Column, comments: Column) -> Column:
    """What an issue's change is told by: its body and comments, not its title."""
    said = F.array_join(F.transform(comments, lambda c: F.concat(c["author"]["login"], F.lit(":"), c["body"])), "\0")
    return F.sha2(F.concat(body, F.lit("\0"), said), 256)


def numbered(docs: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row for each chunk, with chunk_index from 0 within the document.

    The explode is an outer one, as for an inner one Spark would make the chunks once more, to ask whether there are any.
    """
    return docs.select(*[c for c in docs.columns if c != chunks], F.posexplode_outer(chunks).alias("chunk_index", "chunk")).where("chunk_index IS NOT NULL")
