"""op4: both sides of the band reject, and clean labelled texts stay, in every language."""

import random
from collections import Counter


from matchloom.llm import ngram_quality as N


def test_both_sides_of_the_band(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rnd, words = random.Random(12), {}
    for r in docs.collect():
        words.setdefault(r.lang, Counter()).update((r.text or "").split())
    planted = []
    for lang, count in words.items():
        common = [w for w, _ in count.most_common(60) if w.isalpha() and w.islower()][:25]
        shout = [w.upper() + "#!" for w, _ in count.most_common(400) if len(w) > 4]
        planted += [(10**6 + len(planted), " ".join(rnd.choice(common) for _ in range(2500)), lang, "low") for _ in range(3)]
        planted += [(10**6 + len(planted), " ".join(rnd.choice(shout) for _ in range(300)), lang, "high") for _ in range(3)]
    side = {i: s for i, _, _, s in planted}
    got = N.score(docs.unionByName(spark.createDataFrame([p[:3] for p in planted], "doc_id long, text string, lang string"))).collect()
    for r in got:
        if r.doc_id in side and not r.base_failed:
            assert not r.kept and (r.bits_per_byte < r.low if side[r.doc_id] == "low" else r.bits_per_byte > r.high), (r.lang, side[r.doc_id], r.bits_per_byte, r.low, r.high)
    judged = [s for r in got if (s := side.get(r.doc_id)) and not r.base_failed]
    assert judged.count("low") >= 8 and judged.count("high") >= 8
    clean = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert len(clean) > 300 and all(r.kept for r in clean)
    junk = [r for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(not r.kept for r in junk) > 0.8 * len(junk)
