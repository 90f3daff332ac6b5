import datetime as dt
import random

import duckdb

from notarium.operators import facts
from notarium.plans import queries as plans


def simulate(saves):
    """The three statements of a save, one after the other."""
    table = {}
    for seq, domain, category, key, as_of, value in saves:
        rows = [r for r in table.values() if r["key"] == key and r["until"] is None]
        newer = [r["as_of"] for r in rows if r["as_of"] > as_of]
        for r in rows:
            if r["as_of"] <= as_of:
                r["until"] = as_of
        k = (domain, category, key, as_of)
        table[k] = {"id": table.get(k, {"id": seq})["id"], "key": key, "as_of": as_of, "until": min(newer) if newer else None, "value": value}
    return {(*k, r["id"], r["until"], r["value"]) for k, r in table.items()}


def test_resolve_matches_the_sequence_of_statements(spark):
    rng = random.Random(8)
    saves = []
    for seq in range(1, 1200):
        saves.append((seq, rng.choice("de"), rng.choice("cf"), f"k{rng.randrange(60)}", dt.date(2024, 1, 1 + rng.randrange(8)), str(rng.random())))
    got = facts.resolve(spark.createDataFrame(saves, "seq long, domain string, category string, key string, as_of date, value string")).collect()
    assert {(r.domain, r.category, r.key, r.as_of, r.id, r.valid_until, r.value) for r in got} == simulate(saves)


def test_lookup_and_batch_agree(spark):
    rng = random.Random(9)
    saves = [(s, rng.choice("de"), "c", f"k{rng.randrange(5)}", dt.date(2024, 1, 1 + rng.randrange(20)), str(s)) for s in range(80)]
    table = facts.resolve(spark.createDataFrame(saves, "seq long, domain string, category string, key string, as_of date, value string")).persist()
    probes = [(i, f"k{i % 6}", dt.date(2024, 1, 1 + 3 * i)) for i in range(9)]
    many = {r.probe_id: (r.id, r.value) for r in facts.lookup_many(table, spark.createDataFrame(probes, "probe_id int, key string, at date")).collect()}
    for i, key, at in probes:
        one = facts.lookup(table, key, as_of=str(at)).first()
        assert many.get(i) == (one and (one.id, one.value))


def events_of_one_seq(spark, directory):
    """Two tables of the same events, in turned order; up to three share a user and a seq, some rows stand twice."""
    rng, rows = random.Random(10), []
    for e in range(600):
        for copy in range(1 + e % 3):
            day = dt.datetime(2024, 1, 1 + rng.randrange(6))
            rows += [(e + copy * 1000003, day, e % 25, rng.choice("de"), rng.random(), str(len(rows)))] * rng.choice((1, 1, 2))
    dirs = [f"{directory}/{n}" for n in "ab"]
    for d, part in zip(dirs, (rows, rows[::-1])):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    saves = sorted(((e * 7919 % 1000003, e, kind, "metric", str(user), ts.date(), props) for e, ts, user, kind, _, props in rows))
    return dirs, simulate([(seq, *rest) for seq, _, *rest in saves])


def test_saves_of_one_seq_keep_one_order(spark, tmp_path):
    dirs, want = events_of_one_seq(spark, tmp_path)
    for d in dirs:
        got = plans.facts_resolved(spark, d).collect()
        assert {(r.domain, r.category, r.key, r.as_of, r.id, r.valid_until, r.value) for r in got} == want and len(got) == len(want)


def test_overlaps_of_facts_of_one_id_keep_one_order(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("d", "c", "k", day(1), 4, day(9)), ("e", "c", "k", day(1), 4, day(7)), ("e", "f", "k", day(1), 4, day(8)), ("d", "c", "k", day(5), 2, None)]
    want = [("k", 4, day(1), day(7), 4, day(1)), ("k", 4, day(1), day(8), 2, day(5)), ("k", 4, day(1), day(9), 4, day(1))]
    for part in (rows, rows[::-1]):
        table = spark.createDataFrame(part, "domain string, category string, key string, as_of date, id long, valid_until date").coalesce(1)
        assert sorted(tuple(r) for r in facts.overlapping_history(table).collect()) == want


def test_overlaps_of_saves_of_one_seq_match_the_statements(spark, tmp_path):
    dirs, facts_then = events_of_one_seq(spark, tmp_path)
    real = sorted((key, as_of, i, domain, until) for domain, _, key, as_of, i, until, _ in facts_then if until is None or until > as_of)
    assert any(a[:3] == b[:3] for a, b in zip(real, real[1:]))
    want = sorted(str((a[0], a[2], a[1], a[4], b[2], b[1])) for a, b in zip(real, real[1:]) if a[0] == b[0] and (a[4] is None or a[4] > b[1]))
    for d in dirs:
        assert sorted(str(tuple(r)) for r in plans.facts_history_overlap(spark, d).collect()) == want


def rows_and_sql_rows(spark, directory, name, events):
    """The rows of a facts query on these events (event_id, day or None, user, kind), and those of its SQL."""
    rows = [(e, day and dt.datetime(2024, 1, day), user, kind, float(n), str(n)) for n, (e, day, user, kind) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{directory}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{directory}/events.parquet/*.parquet'")
    r = con.execute(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(directory)).select(*[c[0] for c in r.description]).collect()
    return sorted(str(tuple(row)) for row in got), sorted(map(str, r.fetchall()))


def test_saves_without_seq_count_as_in_the_sql(spark, tmp_path):
    rng = random.Random(11)
    events = [(e if e >= 30 else None, 1 + rng.randrange(6), e % 30, rng.choice("de")) for e in range(600)]
    got, want = rows_and_sql_rows(spark, tmp_path, "facts_resolved", events)
    assert got == want


def test_overlaps_of_facts_without_date_or_id_are_those_of_the_sql(spark, tmp_path):
    rng = random.Random(12)
    events = [(e if e >= 30 else None, None if e % 7 == 3 else 1 + rng.randrange(6), e % 30, rng.choice("de")) for e in range(600)]
    events += [(600, None, 50, "d"), (601, 2, 50, "e"), (602, 2, 50, "d")]
    got, want = rows_and_sql_rows(spark, tmp_path, "facts_history_overlap", events)
    assert got == want
