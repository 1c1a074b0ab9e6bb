"""The whole pipeline on small, awkward and empty tables, each stage against a plain version of what it promises."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as C
from leafmill.llm import mixing, pieces, queries, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, n_removed string"


def made():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(160)]
    rows = []
    for i, t in enumerate(texts):
        if i % 3 == 0:
            t += " zonkex zonkil zonkort zonkex."
        if i % 7 == 1:
            t += f" Write to user{i}@mail.example.org or +1 743 555 {1000 + i}."
        rows.append([i, t, "en", f"src{i % 4}" if i % 5 else None])
    rows += [[1000 + i, rows[i][1], "en", "copies"] for i in range(0, 60, 2)]  # exact copies
    rows += [[2000, None, None, None], [2001, "", "en", ""], [None, "one lonely line", "en", "src1"], [None, rows[4][1], "en", "src1"], [None, "one lonely line", "en", "src1"]]
    rows += [[5, "another text under a known id, quite different from it", "en", "src2"], [2002, "long " + "w x y z " * 20000, "en", "src3"]]
    return [(i, t, lang, s, len(t or ""), 1, "x") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows = made()
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{where}/documents.parquet")
    toxic = [(i, int(i % 2), int("zonk" in (t or ""))) for i, t, *_ in rows if i is not None and i < 140]
    spark.createDataFrame([*toxic, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_one_after_the_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_dedup", "pii_surrogates", "mixing", "sentencepiece"]
    seen = {}
    for name, stage in C.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        after = [tuple(r) for r in out.collect()]
        seen[name] = (before, after)
        docs = spark.createDataFrame(after, COLUMNS).repartition(3)
    before, after = seen["toxicity"]
    assert Counter(after) == Counter(r for r in before if "zonk" not in (r[1] or ""))
    before, after = seen["simhash_dedup"]
    sets = [frozenset(simhash.shingle_set(r[1]).tolist()) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    assert len(after) == len(set(group)) and not Counter(after) - Counter(before)
    for g in set(group):
        ids = [r[0] for r, k in zip(before, group, strict=True) if k == g]
        mine = [r for r in after if r in [x for x, k in zip(before, group, strict=True) if k == g]]
        assert [m[0] for m in mine] == [min((i for i in ids if i is not None), default=None)]
    before, after = seen["pii_surrogates"]
    assert len(before) == len(after)
    old, new = ({r[0]: r[1] for r in x if r[0] is not None} for x in (before, after))
    for i, t in old.items():
        if t and "@" in t:
            want = re.sub(r"user\d+@mail\.example\.org|\+1 743 555 \d+", "#", t)
            assert new[i] != t and re.sub(r"\S+@\S+\.org|\+1 \d{3} \d{3} \d+", "#", new[i]) == want
        else:
            assert new[i] == t
    before, after = seen["mixing"]
    took, had = Counter(), Counter()
    for rows, count in ((after, took), (before, had)):
        for r in rows:
            count[r[3]] += len(re.findall(mixing.WORD, r[1] or ""))
    assert not Counter(set(after)) - Counter(set(before)) and max(Counter(after).values()) <= 2
    assert all(took[s] <= 2 * had[s] for s in had) and sum(took.values()) > sum(had.values())


def test_run_gives_ids_that_decode(spark, tables):
    got = C.run(spark, tables).collect()
    assert got and all(r.exact for r in got)
    again = C.run(spark, tables).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert not pieces.parity(queries._piece_file(), [t for _, t, *_ in made() if t])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
