"""The corpus pipeline over the smallest tables, stage by stage against brute force."""

import re
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from lakelens.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns
        kept.append(docs.collect())
    start, clean, exact, near, mixed, packed = kept
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in clean} == {r.doc_id for r in start if model.score(r.text) < 0.5}
    groups = defaultdict(list)
    for r in clean:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(min(g)[1] for g in groups.values())
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r.text or "").encode().lower().split()) else set() for r in exact}
    least = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(5):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(r.doc_id for r in near) == sorted(i for i in sets if least[i] == i)
    counts = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(near, docs.sparkSession.read.parquet(f"{SF}/documents.parquet").schema)).collect() if r.taken}
    assert Counter(r.doc_id for r in mixed) == Counter(counts)
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == Counter({i: n * len((next(r.text for r in near if r.doc_id == i) or "").encode().split()) for i, n in counts.items()})


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.OP8_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in sorted(names)) for r in queries.op8_exact_dedup(spark, SF).collect()) == want
