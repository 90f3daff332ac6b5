r"""Benchmark decontamination by a distributed positional inverted index (operator 10, DataFrame functions only).

Terms of the benchmark are counted over the whole corpus.  Each window of ten item words is looked up by its rarest
terms.  The index holds the training postings (term, row, position) of those terms; it is written down and read by both
lookups.  A posting at position p of the term at offset q of an item gives the alignment p - q.

* Exact: postings of the ANCHORS rarest terms of each window are intersected on (row, item, alignment), which leaves
  hardly more than the true occurrences.  Each surviving alignment is then compared with its own text, word by word, so
  that results are exact; hits are the runs of matches as long as a window.
* Proximity: a window matches near place s of a document if all but one of its ten words stand at most SLOP words behind
  where they would stand if it began at s.  Of the NEAR_ANCHORS rarest terms of such a window at least two are there, with
  alignments within SLOP; these meet in overlapping cells of alignments, and each text is then checked place by place.
  So windows with a word exchanged, or with up to SLOP words put in, are found.  They are reported beside the exact ones
  and change neither n_hit nor contaminated.

Neighbouring windows share their rarest terms, so an item brings a few postings lists, not one per window.  Lists are
joined by term and never gathered: a term that a third of all rows hold is only as wide as its own rows, which the join
splits.  What is gathered per document is bounded by the document: its own alignments.

Defined cases: a null text has no words; an item of fewer than ten words, but at least one, is one window of all its
words, and has no proximity matches; an item without words matches nothing; items of one id are one item; repeated rows
each get the same result; an empty table on either side gives rows without hits, or no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ANY_CASE_SEPARATORS, TERM_SEPARATORS, ascii_lower, discard, materialise, words

WINDOW = 10
ANCHORS, NEAR_ANCHORS = 2, 3
SLOP = 2


def terms(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), TERM_SEPARATORS)


def row_key(docs: DataFrame) -> Column:
    """Ties a posting to its row: rows with the same id and text share it, which does no harm, as each text is checked."""
    return F.xxhash64("doc_id", "text")


def benchmark_items(bench: DataFrame) -> DataFrame:
    """(item, item_id, item_terms): one row for each distinct id and text with words; item numbers the row."""
    rows = bench.select(F.col("item_id"), terms(F.col("text")).alias("item_terms")).where(F.size("item_terms") > 0).distinct()
    return rows.withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "item_terms")))


def item_words(items: DataFrame) -> DataFrame:
    """(item, offset, term, n) for each word of each item; n is the item's number of words."""
    return items.select("item", F.size("item_terms").alias("n"), F.posexplode("item_terms").alias("offset", "term"))


def corpus_words(docs: DataFrame, with_position: bool) -> DataFrame:
    text = terms(F.col("text"))
    if with_position:
        return docs.select(row_key(docs).alias("row"), F.posexplode(text).alias("pos", "term"))
    return docs.select(F.explode(text).alias("term"))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n) over all documents, 0 for a term that none has.  Counts are summed before they are shuffled."""
    counts = corpus_words(docs, False).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, each: int = NEAR_ANCHORS) -> DataFrame:
    """(item, offset, term, n, place): the `each` rarest words of every window; place is the best that a word has in any."""
    ranked = item_words(items).join(counts.withColumnRenamed("n", "uses"), "term")
    # a word belongs to the windows that begin up to window - 1 words before it, within the item
    last = F.greatest(F.col("n") - window, F.lit(0))
    placed = ranked.withColumn("begin", F.explode(F.sequence(F.greatest(F.col("offset") - window + 1, F.lit(0)), F.least(F.col("offset"), last))))
    rarest = W.partitionBy("item", "begin").orderBy("uses", "term", "offset")
    chosen = placed.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= each)
    return chosen.groupBy("item", "offset", "term", "n").agg(F.min("r").alias("place"))


def positional_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The postings (term, row, pos), of all terms or of those in vocabulary (term)."""
    postings = corpus_words(docs, True)
    return postings if vocabulary is None else postings.join(vocabulary, "term", "left_semi")


def alignments(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """(row, item, shift) at which ANCHORS anchors of the item, or all its words if fewer, are found at their offsets."""
    met = index.join(lookups.where(F.col("place") <= ANCHORS), "term").select("row", "item", "n", (F.col("pos") - F.col("offset")).alias("shift"))
    met = met.groupBy("row", "item", "shift").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    return met.where(F.col("met") >= F.least(F.lit(ANCHORS), F.col("n"))).select("row", "item", "shift")


def near_alignments(index: DataFrame, lookups: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(row, item, cell): two anchors of an item within a window of each other have alignments in the cell.

    Cells are as wide as two stretches of slop + 1 alignments and overlap by one, so that alignments within slop share one.
    Offsets are dealt in the same way by stretches of `window`.  A document's alignments with an item are brought together
    first, within the task that read them; only where two of them are within slop are they dealt to cells, and that
    needs no further shuffle.
    """
    met = index.join(lookups.where(F.col("n") >= window), "term").select("row", "item", F.struct((F.col("pos") - F.col("offset")).alias("at"), "offset").alias("x"))
    own = met.groupBy("row", "item").agg(F.collect_list("x").alias("xs")).where("size(xs) > 1").select("row", "item", F.sort_array("xs").alias("xs"))
    near = own.where(F.exists(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i)["at"] - F.get("xs", i - 1)["at"] <= slop))
    each = near.select("row", "item", F.explode("xs").alias("x")).select("row", "item", F.col("x.at").alias("at"), F.col("x.offset").alias("offset"))
    cell, part = F.floor(F.col("at") / (slop + 1)).cast("int"), F.floor(F.col("offset") / window).cast("int")
    spread = each.select("row", "item", "offset", F.explode(F.array(cell, cell + 1)).alias("cell"), F.array(part, part + 1).alias("parts"))
    spread = spread.select("row", "item", "offset", "cell", F.explode("parts").alias("part"))
    several = spread.groupBy("row", "item", "cell", "part").agg((F.min("offset") < F.max("offset")).alias("two")).where("two")
    return several.select("row", "item", "cell").distinct()


def _runs(matches: Column, width: Column) -> Column:
    """(begin, length) of the runs of consecutive ascending positions that have at least `width` of them."""
    zero = F.array().cast("array<struct<b:int,n:int>>")
    step = lambda acc, p: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] + F.element_at(acc, -1)["n"] == p),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["b"].alias("b"), (F.element_at(acc, -1)["n"] + 1).cast("int").alias("n")))),
    ).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("b"), F.lit(1).cast("int").alias("n")))))
    return F.filter(F.aggregate(matches, zero, step), lambda r: r["n"] >= width)


def gathered(found: DataFrame, items: DataFrame, place: str) -> DataFrame:
    """(row, found): what was found in each row, an array of (item_id, item_terms, place)."""
    return found.join(items.select("item", "item_id", "item_terms"), "item").groupBy("row").agg(F.collect_set(F.struct("item_id", "item_terms", place)).alias("found"))


def _exact(w: Column, f: Column, window: int) -> Column:
    """Runs (item_id, b, n) of the words w that match item f at its shift."""
    at = F.filter(
        F.sequence(F.lit(0), F.size(f["item_terms"]) - 1),
        lambda q: F.get(f["item_terms"], q) == F.when(f["shift"] + q >= 0, F.get(w, f["shift"] + q)),
    )
    runs = _runs(at, F.least(F.lit(window), F.size(f["item_terms"])))
    return F.transform(runs, lambda r: F.struct(f["item_id"].alias("item_id"), (r["b"] + f["shift"]).alias("b"), r["n"].alias("n")))


def _is_near(w: Column, f: Column, window: int, slop: int) -> Column:
    """Whether a window of item f matches the words w near any place that its cell stands for."""

    def there(s: Column, q: Column) -> Column:
        within = [F.coalesce(F.get(f["item_terms"], q) == F.when(s + q + j >= 0, F.get(w, s + q + j)), F.lit(False)) for j in range(slop + 1)]
        either = within[0]
        for x in within[1:]:
            either = either | x
        return either

    def missing(s: Column) -> Column:
        """Item offsets that are not there, with a mark before and behind the item, in order."""
        no = F.filter(F.sequence(F.lit(0), F.size(f["item_terms"]) - 1), lambda q: ~there(s, q))
        return F.concat(F.array(F.lit(-1)), no, F.array(F.size(f["item_terms"])))

    def holds(no: Column) -> Column:
        """Whether a window fits between an offset that isn't there and the one after the next."""
        return F.exists(F.sequence(F.lit(0), F.size(no) - 1), lambda i: F.coalesce(F.get(no, i + 2), F.element_at(no, -1)) - F.get(no, i) > window)

    first = (f["cell"] - 1) * (slop + 1)
    places = F.transform(F.sequence(first, first + slop + 1), missing)
    return F.exists(places, holds)


def _ids(found: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(found, lambda f: f["item_id"].cast("string"))))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = SLOP, proximity: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, spans, near_items) for each row of docs.

    spans: (item_id, b, n) of the runs of document words that match exactly; near_items: ids of the items with a window
    that matches by proximity, exact ones among them (none without proximity).
    """
    items = materialise(benchmark_items(bench), "items")
    vocabulary = item_words(items).select("term").distinct()
    counts = materialise(term_counts(docs, vocabulary), "counts")
    lookups = materialise(anchors(items, counts, window, NEAR_ANCHORS if proximity else ANCHORS), "anchors")
    index = materialise(positional_index(docs, lookups.select("term").distinct()), "index")
    close = near_alignments(index, lookups, window, slop) if proximity else alignments(index, lookups).where("false").withColumnRenamed("shift", "cell")
    exact, near = (gathered(f, items, place).withColumnRenamed("found", c) for f, place, c in ((alignments(index, lookups), "shift", "exact"), (close, "cell", "near")))
    found = materialise(exact.join(near, "row", "full_outer"), "found")
    for old in (items, counts, lookups, index):
        discard(old)
    n_words = F.size(words(F.col("text"), ANY_CASE_SEPARATORS)).cast("long").alias("n_words")
    rows = docs.select("doc_id", "text", row_key(docs).alias("row")).join(found, "row", "left")
    # only texts in which something was found are cut into words
    cut = rows.select("doc_id", n_words, "exact", "near", F.when(F.col("exact").isNotNull() | F.col("near").isNotNull(), terms(F.col("text"))).alias("w"))
    spans = F.when(F.col("exact").isNotNull(), F.flatten(F.transform("exact", lambda f: _exact(F.col("w"), f, window))))
    near_items = F.when(F.col("near").isNotNull(), _ids(F.filter("near", lambda f: _is_near(F.col("w"), f, window, slop))))
    matched = cut.select("doc_id", "n_words", spans.alias("spans"), F.coalesce(near_items, F.array().cast("array<string>")).alias("near_items"))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["b"].alias("b"), (s["b"] + s["n"]).alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    merged = F.aggregate(ordered, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["e"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["end"], s["b"]))).alias("total"),
    ))
    return matched.select(
        "doc_id", "n_words", F.coalesce(merged["total"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(_ids(F.col("spans")), F.array().cast("array<string>")).alias("items"), "spans", "near_items",
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "spans", "near_items",
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, in the columns of docs."""
    verdicts = decontaminate(docs, bench, window, proximity=False).where("contaminated").select("doc_id").distinct()
    return docs.alias("d").join(verdicts.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")), "left_anti")
