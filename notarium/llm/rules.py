r"""Quality rules, line first (operator 7, DataFrame functions only).

Each line is judged by itself: by its punctuation (symbol noise, shouting, or a longer line without any sentence
mark), as navigation (cells between separators) and as boilerplate (a fixed phrase, in English, French, German or
Spanish, in a line of at most PHRASE_LINE words, so that prose may mention one).  Lines that fail are removed; the
document is then rejected when the lines that are left hold less than KEEP_SHARE of its words.  Two rules on the whole
text come before: fewer than MIN_WORDS words, or too many words in repeated windows of five.

Everything is computed within the row, with no shuffle: a text of any length stays in the task that read it.  Windows
are compared by 64-bit hashes; they are sorted only in texts where some window occurs twice.

Defined cases: a null or blank text has no words and fails by MIN_WORDS; lines without a word are neither judged nor
counted; repeated rows are judged one by one; an empty table gives no rows; columns that clash with those that are
added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import shielded, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
KEEP_SHARE = 0.5

#: A longer line doesn't fail by a phrase.
PHRASE_LINE = 15
#: Phrases that mark a short line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "sign in to", "subscribe to", "terms of service", "terms of use",
    "tous droits réservés", "cliquez ici", "politique de confidentialité", "mentions légales", "conditions d'utilisation",
    "alle rechte vorbehalten", "hier klicken", "datenschutzerklärung", "impressum und datenschutz", "nutzungsbedingungen",
    "todos los derechos reservados", "haga clic aquí", "política de privacidad", "aviso legal", "términos de uso",
)
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines", "n_bad_lines", "kept_words")


def repeated_words(hashes: Column) -> Column:
    """The windows (h, i) in order of their hashes, null where none occurs twice."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed)


def _covered(placed: Column) -> Column:
    """Positions of the windows whose hash a neighbour in sorted order shares, in ascending order."""
    same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))


def _union_length(starts: Column, width: int) -> Column:
    """Length of the union of [s, s + width) over ascending starts."""
    gaps = F.transform(starts, lambda s, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - s, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)


def without(text: Column, characters: str) -> Column:
    """The text without any of these characters; for characters that are as frequent as spaces, cheaper than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among these."""
    return F.regexp_count(text, F.lit("[" + "".join(f"\\x{{{ord(c):X}}}" for c in characters) + "]"))


def line_fails(line: Column, low: Column, n_words: Column) -> Column:
    """The verdict on one line with n_words words; low is the line in lower case."""
    noise = 10 * count_of(line, SYMBOLS) > 3 * n_words
    shouting = (n_words >= 4) & (low != line) & (F.upper(line) == line)
    unfinished = (n_words >= 8) & ~F.rlike(line, F.lit("[.!?:;]"))
    navigation = (n_words >= 3) & (5 * count_of(line, "|>•»") >= n_words)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    return noise | shouting | unfinished | navigation | ((n_words <= PHRASE_LINE) & boilerplate)


def judge(docs: DataFrame) -> DataFrame:
    """docs with n_words, the base figures, base_failed, kept, clean_text, n_lines, n_bad_lines and kept_words.

    Each text is cut into lines and these into words once; what the words are needed for comes from their hashes.
    """
    passed = [c for c in docs.columns if c.lower() not in _ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*passed, F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    cut = split.select(*passed, "_lines", F.transform("_lines", lambda x: F.transform(words(x), lambda w: F.xxhash64(w))).alias("_lw"))
    flat = cut.select(*passed, F.transform(F.arrays_zip("_lines", "_lw"), lambda x: F.struct(x["_lines"].alias("line"), F.lower(x["_lines"]).alias("low"), F.size(x["_lw"]).alias("n"))).alias("_l"), F.flatten("_lw").alias("_h"))
    windows = F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = flat.select(*passed, "_l", F.size("_h").cast("long").alias("n_words"), windows.alias("_w"))
    placed = hashed.select(*passed, "_l", "n_words", repeated_words(F.col("_w")).alias("_p"))
    starts = placed.select(*passed, "_l", "n_words", F.when(F.col("_p").isNotNull(), _covered(F.col("_p"))).alias("_s"))
    counted = starts.select(
        *passed, "_l", "n_words",
        F.char_length(without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct(F.transform("_l", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_s").isNotNull(), _union_length(F.col("_s"), WINDOW)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("_l", lambda x: ~line_fails(x["line"], x["low"], x["n"])).alias("_g"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.aggregate("_g", F.lit(0), lambda acc, x: acc + x["n"]).cast("long")
    judged = counted.withColumns({
        "base_failed": base,
        "n_lines": F.size("_l"),
        "n_bad_lines": F.size("_l") - F.size("_g"),
        "kept_words": left,
        "clean_text": F.array_join(F.transform("_g", lambda x: x["line"]), "\n"),
    })
    kept = ~F.col("base_failed") & (F.col("kept_words") >= KEEP_SHARE * F.col("n_words"))
    return judged.withColumn("kept", kept).drop("_l", "_g")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that failed; the columns of docs, n_chars (if there) counted anew.

    A text none of whose lines fails is passed on byte for byte.
    """
    # a filter on kept would be pushed below and evaluate every rule once more per use; it stays above a column that isn't
    # deterministic
    own, now = shielded(docs, (*_ADDED, "_h", "_w", "_p", "_s", "_l", "_g", "_lw", "_lines", "_part"))
    judged = judge(own).withColumn("_part", F.spark_partition_id()).where("kept AND _part >= 0")
    text = F.when(F.col("n_bad_lines") == 0, F.col("text")).otherwise(F.col("clean_text"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return judged.select(*[new.get(n, F.col(n)).alias(c) for n, c in zip(now, docs.columns, strict=True)])
