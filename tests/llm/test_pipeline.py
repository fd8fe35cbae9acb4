import re
from collections import Counter

import corpus_pipeline
from test_classify_mix_pack import SF, mixed, plain_ids

SMALL = SF.replace("sf0.01", "sf0.001")


def test_stages_match_plain_versions(spark, tmp_path):
    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        columns = docs.columns
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        kept = Counter(r.doc_id for r in rows)
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0").collect()}
            assert 0.7 * len(before) < len(rows) < len(before) and len(bad & set(kept)) <= len(bad) / 4
        elif name == "exact_dedup":
            last = {}
            for i, t, _ in sorted(before):
                last[re.sub("[A-Z]", lambda m: m[0].lower(), t)] = i
            assert kept == Counter(last.values())
        elif name == "ngram_jaccard_join":
            sets = {}
            for i, t, _ in before:
                w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
                sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
            left, expected = set(sets), set()
            while left:
                front = [min(left)]
                expected.add(front[0])
                left -= set(front)
                while front:
                    front = [j for j in left if any(len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]) for k in front)]
                    left -= set(front)
            assert set(kept) == expected
        elif name == "source_mixing":
            assert kept == mixed(before, 0.95, 4.0, None)
        else:
            assert sum(r.length for r in rows) == sum(map(len, plain_ids([(i, t) for i, t, _ in before])))
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows)
