import random
import re

from pyspark.sql import functions as F

from notarium.operators import chunking

MAX, MIN, OVER = 6000, 200, 800


def split(t, size=MAX, over=OVER):
    if len(t) <= size:
        return [t]
    out, i = [], 0
    while i < len(t):
        out.append(t[i : i + size])
        if i + size >= len(t) or size <= over:
            break
        i += size - over
    return out


def emit(t, least):
    return split(t) if len(t) > MAX else [t] if len(t.strip()) >= least else []


def pack(paragraphs, prefix, first_only, least):
    out, b = [], ""
    for p in paragraphs:
        pre = "" if first_only and out else prefix
        joined = f"{b}\n\n{p}" if b else p
        if len(pre) + len(joined) > MAX and b:
            out += emit(pre + b, least)
            b = p
        else:
            b = joined
    if b.strip():
        out += emit(("" if first_only and out else prefix) + b, least)
    return out


def markdown(content):
    lines, front = content.split("\n"), ""
    if lines[0].strip() == "---" and "---" in lines[1:]:
        k = lines.index("---", 1)
        front, lines = "\n".join(lines[: k + 1]), lines[k + 1 :]
    stack, own, out = [], [], []

    def flush():
        text = "\n".join(own).strip()
        own.clear()
        if len(text) < MIN:
            return
        crumb = " > ".join(f"{'#' * n} {t}" for n, t in stack)
        prefix = (front + "\n\n" if front and not out else "") + (crumb + "\n\n" if crumb else "")
        parts = [prefix + text] if len(prefix + text) <= MAX else pack([p for p in text.split("\n\n") if p.strip()], prefix, False, 0)
        out.extend((p, crumb or None) for p in parts)

    for line in lines:
        m = re.fullmatch(r"(#{1,3})\s+([^\r  ]+)", line)
        if m:
            flush()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
        else:
            own.append(line)
    flush()
    return out


def pages(items):
    merged, now, first = [], items[0] if items else "", 1
    for i in range(1, len(items)):
        prev = now.strip()
        if (prev and not re.search(r"[.!?:;)\]\"']\s*$", prev)) or len(prev) < MIN:
            now = prev + "\n\n" + items[i].strip()
        else:
            merged.append((prev, first, i))
            now, first = items[i].strip(), i + 1
    if items:
        merged.append((now.strip(), first, len(items)))
    return merged


def page_chunks(items):
    out = []
    for text, a, z in pages(items):
        if len(text) >= MIN:
            prefix = (f"[Page {a}]" if a == z else f"[Pages {a}-{z}]") + "\n\n"
            parts = [prefix + text] if len(prefix + text) <= MAX else pack([p for p in text.split("\n\n") if p.strip()], prefix, False, 0)
            out += [(p, a - 1, z - 1) for p in parts]
    return out


def issue(number, title, body, comments):
    pre = f"[Issue #{number}: {title}]"
    out, run = emit(f"{pre}\n\n{body}".strip(), MIN), []

    def flush():
        if run:
            out.extend(emit(f"{pre} Conversation:\n\n" + "\n\n".join(run), MIN))
            run.clear()

    for who, text, at in comments:
        t = text.strip()
        if len(t) < 50:
            continue
        full = f"{pre} Comment by @{who} ({at[:10]}):\n\n{t}"
        if len(full) < MIN:
            run.append(f"@{who} ({at[:10]}):\n{t}")
        else:
            flush()
            out.extend(emit(full, MIN))
    flush()
    return out


def prose(rng, n):
    return " ".join(rng.choice(["word", "longer-word", "a", "end.", "x"]) for _ in range(n))


def test_hard_split(spark):
    cases = [("abcdefghij", 6, 2), ("x" * 150, 100, 20), ("x" * 200, 100, 20), ("abc", 3, 3), ("abcdef", 3, 3), ("", 5, 1)]
    for t, size, over in cases:
        got = spark.createDataFrame([(t,)], "t string").select(chunking.hard_split(F.col("t"), size, over)).first()[0]
        assert got == split(t, size, over)
    assert split("abcdefghij", 6, 2) == ["abcdef", "efghij"]


def test_text_chunks(spark):
    rng = random.Random(1)
    texts = ["", " \n\n ", "short"] + ["\n\n".join(prose(rng, rng.choice((1, 40, 900, 2500))) + rng.choice(("", "  ")) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.text_chunks(F.col("t"), F.lit("f.txt")).alias("c")).collect()
    for r in rows:
        want = pack([p.strip() for p in texts[r.i].split("\n\n") if p.strip()], "[Source: f.txt]\n\n", True, MIN)
        assert r.c == want


def test_markdown_chunks(spark):
    rng = random.Random(2)
    texts = ["", "---\ntype: x\n---\n" + prose(rng, 60), "--- \na: 1\n---\r\n# H\n" + prose(rng, 80), "---\nopen\n# A\n" + prose(rng, 60), "# T\r\n" + prose(rng, 60)]
    for _ in range(30):
        lines = []
        for _ in range(rng.randint(1, 25)):
            lines.append(rng.choice(["", "# One ", "## Two", "### Three", "#### Four", "#no", prose(rng, 70), prose(rng, 3), prose(rng, 1800)]))
        texts.append(rng.choice(("", "---\nk: v\n---\n")) + rng.choice(("\n", "\n\n")).join(lines))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    for r in chunking.markdown_chunks(rows).collect():
        assert [(c.content, c.heading) for c in r.chunks] == markdown(texts[r.i]), r.i


def test_pages(spark):
    rng = random.Random(3)
    docs = [[], ["Title"], ["a" * 300 + ".", "b" * 300]] + [[prose(rng, rng.choice((2, 60, 1500))) + rng.choice(("", " ", ".")) for _ in range(rng.randint(1, 9))] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, pages array<string>")
    for r in rows.select("i", chunking.merged_pages(F.col("pages")).alias("m"), chunking.page_chunks(F.col("pages")).alias("c")).collect():
        assert [tuple(x) for x in r.m] == pages(docs[r.i])
        assert [tuple(x) for x in r.c] == page_chunks(docs[r.i])


def test_issues(spark):
    rng = random.Random(4)
    rows = []
    for n in range(30):
        comments = [(rng.choice("ab"), " " * rng.randint(0, 3) + prose(rng, rng.choice((3, 12, 20, 60, 2000))), "2024-05-06T07:08:09Z") for _ in range(rng.randint(0, 12))]
        rows.append((n, f"T{n}", prose(rng, rng.choice((1, 50, 2000))), comments))
    data = [(n, t, b, [((w,), x, at) for w, x, at in cs]) for n, t, b, cs in rows]
    df = spark.createDataFrame(data, "number int, title string, body string, comments array<struct<author:struct<login:string>,body:string,createdAt:string>>")
    got = df.select("number", chunking.issue_chunks(*map(F.col, ("number", "title", "body", "comments"))).alias("c")).collect()
    for r in got:
        assert r.c == issue(*rows[r.number]), r.number


def test_noise(spark):
    from notarium.functions.text import is_noise

    texts = ["+1", "👍" * 60, "lol " * 20, "!" * 70, "🎉 +1 " * 20, "word" * 20]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(is_noise(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, True, False, False]
