import hashlib
import random
import re

from leafmill.llm import minhash as M


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def bins_of(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return M.with_bins(df, "t", "b").first().b


def test_bins_against_plain_loops(spark):
    from pyspark.sql import functions as F

    def h64(*xs):  # chained as the engine chains it, seed first
        return spark.range(1).select(F.xxhash64(*[F.lit(x) for x in xs]).alias("h")).first().h

    text = "A b c d e f g"
    ws = [h64(w) for w in words(text)]
    mins = {}
    for i in range(3):
        h = h64(*ws[i : i + 5]) & (2**63 - 1)
        b, v = h >> M.SHIFT, h & (1 << M.SHIFT) - 1
        mins[b] = min(v, mins.get(b, v))
    want = []
    for b in range(M.BINS):
        if b in mins:
            v = mins[b]
        else:
            hit = [j for j in (M._mixed(b, a) % M.BINS for a in range(M.PROBES)) if j in mins]
            v = mins[hit[0]] if hit else mins[min(mins, key=lambda j: spark_hash(spark, b, j))]
        want.append(v & 255)
    assert bins_of(spark, text) == want


_CACHE = {}


def spark_hash(spark, b, j):
    from pyspark.sql import functions as F

    if (b, j) not in _CACHE:
        salts = [M._mixed(x, 99) >> 2 for x in range(M.BINS)]
        rows = spark.range(M.BINS).withColumn("s", F.get(F.lit(salts), F.col("id").cast("int"))).withColumn("h", F.xxhash64("s", F.lit(j)))
        for r in rows.collect():
            _CACHE[(r.id, j)] = r.h
    return _CACHE[(b, j)]


def test_likeness_is_near_the_truth(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for n in (6, 30, 200, 1500):
        for share in (0.0, 0.1, 0.4, 0.9, 1.0):
            a = [r.choice(vocab) for _ in range(n)]
            cut = int(n * share)
            rows.append((" ".join(a), " ".join(a[:cut] + [r.choice(vocab) for _ in range(n - cut)])))
    df = spark.createDataFrame(rows, "a string, b string")
    df = M.add_fingerprint(M.add_fingerprint(df, "a", "fa"), "b", "fb")
    gaps = [abs(x.n - jaccard(x.a, x.b)) for x in df.withColumn("n", M.likeness(df.fa, df.fb)).collect()]
    assert max(gaps) < 0.13 and sum(gaps) / len(gaps) < 0.025


def test_query_rows(spark):
    r = random.Random(8)
    texts = [None, "", " \t", "é🙂a", "one two three four", "x " * 40000] + [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = [(i * 7 - 50, t, 1) for i, t in enumerate(texts)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(5)
    got = {x.doc_id: x for x in M.edited_likeness(docs).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x.near_edited - jaccard(t, edited)) < 0.15 and abs(x.near_next - jaccard(t, nxt)) < 0.15
        assert len(x.fingerprint) == 512 and (t != edited or x.fingerprint == x.edited_fingerprint and x.near_edited == 1)
    assert M.edited_likeness(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, "e f g"), (None, None)], "doc_id long, text string")
    got = M.edited_likeness(docs).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "2", "None", "None"]
    one = M.edited_likeness(docs.filter("doc_id = 2")).first()
    assert one.near_next == 1 and one.near_edited < 0.2
    assert M.edited_likeness(docs.filter("doc_id is null")).count() == 2
