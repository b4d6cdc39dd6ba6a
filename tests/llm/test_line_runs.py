import random
from collections import defaultdict

from pyspark.sql import functions as F

from parley.llm.line_runs import LineRuns, dedup_lines, flags

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=40, min_docs=5):
    rank = lambda i: -10**30 if i is None else i
    key = lambda line: line.strip(SPACE).translate(LOW)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df, **k):
    return sorted(map(tuple, dedup_lines(df, **k).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice(("Alpha", "béta", "GAMMA", "Ünter", "Σας")) for _ in range(12)) for _ in range(30)]
    dress = [lambda x: x, lambda x: f" \t{x}\x0b", lambda x: x.translate(LOW), lambda x: f" {x}", lambda x: x[:39]]
    docs = []
    for i in range(150):
        lines = [rnd.choice(dress)(rnd.choice(pool)) if rnd.random() < 0.6 else f"own {rnd.random()}" for _ in range(rnd.randrange(12))]
        docs.append((rnd.randrange(100), "\n".join(lines)))  # ids repeat
    docs += [(1000 + i, pool[0]) for i in range(60)]  # one line fills a third of the rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert sum(r[2] for r in want) > 100
    for options in ({"batches": 1}, {"batches": 5, "fanout": 2}, {"batches": 3, "hot_keys": 1}):
        assert result(df, **options) == want
    assert result(df, min_chars=1, min_docs=2, batches=2) == brute(docs, 1, 2)


def test_edges(spark):
    line = "A line that is long enough to be taken as a key"
    long = "\n".join([line, *(f"line {i} of a very long document, which is kept {i % 7}" for i in range(20000)), line])
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, f"{line}\n{line}"), (None, line), (5, long), (6, line.upper()), (6, f"x\n{line}"), (8, f"\n{line}\n")]
    df = spark.createDataFrame([(*d, "z", 7, "k") for d in docs], "doc_id long, text string, id string, n_lines long, `a.b` string")
    assert result(df, batches=2) == brute(docs)
    out = dedup_lines(df, batches=2)
    assert out.columns == ["doc_id", "id", "a.b", "text", "n_lines", "n_dropped"]
    assert out.where("`a.b` = 'k' and id = 'z'").count() == len(docs)
    assert dedup_lines(df.limit(0)).count() == 0


def test_runs_are_merged_and_settled_keys_leave_no_trace(spark):
    runs = LineRuns(spark, min_docs=2, buckets=3, fanout=2)
    for b in range(5):  # descending ids
        rows = [(100 - 10 * b - i, 1, 1) for i in range(3)] + [(100 - 10 * b, 7 + b, 0)]
        runs.add(spark.createDataFrame(rows, "id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(map(tuple, runs.merged().collect())) == [(1, 1, 3, 100)] + [(7 + b, 0, 1, 100 - 10 * b) for b in range(5)]
    again = runs.unsettled(spark.createDataFrame([(1, 1), (7, 0), (9, 9)], "h1 long, h2 long").withColumn("n_docs", F.lit(1)), 2).select("h1", "h2")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, again.collect())) == [(7, 0), (9, 9)]
    assert [tuple(r) for r in runs.repeated().collect()] == [(1, 1, 3, 100)]


def test_flags(spark):
    df = spark.createDataFrame([([0, 3, 4],), ([2],)], "d array<int>")
    got = [r[0] for r in df.select(flags(F.col("d"))).collect()]
    assert got == [[True, False, False, True, True], [False, False, True]]


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
