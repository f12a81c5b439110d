"""The pipeline against plain Python on a small corpus with planted copies, near copies and junk."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
from rankloom.llm.common import give_back, worker_cache
from rankloom.llm.encoder import encoder, tokenizer_path
from rankloom.llm.simhash import fingerprint

WORDS = ["river", "stone", "cloud", "paper", "window", "garden", "music", "bread", "winter", "lamp", "house", "tree", "light", "night", "water", "green"]
WORTE = ["fluss", "stein", "wolke", "papier", "fenster", "garten", "musik", "brot", "winter", "lampe", "haus", "baum", "licht", "nacht", "wasser", "gruen"]


def corpus():
    rng, rows = random.Random(5), []
    for i in range(300):
        words = WORDS if i % 3 else WORTE
        rows.append([i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 400))), "en" if i % 3 else "de", f"s{min(i % 8, 3)}"])
    for k in range(30):  # exact copies
        rows.append([1000 + k, rows[k][1], rows[k][2], "copies"])
    long = " ".join(rng.choice(WORDS) for _ in range(6000))
    rows.append([2000, long, "en", "near"])
    rows += [[2001 + k, long + " " + w, "en", "near"] for k, w in enumerate(WORDS[:5])]
    junk = [[3000, None, "en", "junk"], [3001, "", None, None], [3002, "12 34 ...", "de", "junk"], [3003, "qxzj wvkq zzxqj qqkx jjzx " * 60, "en", "junk"]]
    return rows, junk


def test_run_against_plain_python(spark, tmp_path):
    rows, junk = corpus()
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows + junk]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    by_text = defaultdict(list)
    for i, t, *_ in rows:
        by_text[t].append(i)
    kept = {max(ids): t for t, ids in by_text.items()}
    prints, parent = {i: fingerprint(t) for i, t in kept.items()}, {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: kept[i] for i in kept if find(i) == i}
    assert len(want) < len(kept)  # near copies are found

    tables, got = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, str(tmp_path))
        got.write.parquet(f"{tmp_path}/{name}")
        tables[name] = got = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {name: {r[0] for r in t.select("doc_id").collect()} for name, t in tables.items()}
    assert all(tables[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert ids["language_id"] == {i for i, *_ in rows}
    assert ids["exact_dedup"] == set(kept)
    assert ids["simhash_dedup"] == ids["mixing"] == ids["packing"] == set(want)
    e = encoder(tokenizer_path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in tables["packing"].collect():
        pieces[r.doc_id].append(r)
    for i, t in want.items():
        ids_ = e.encode([t])[0] + b"\2\0\0\0"
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in own) * 4 == len(ids_)
        assert all(r.ids_crc32 == zlib.crc32(ids_[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32")
    assert {r.doc_id for r in again.collect()} == set(want)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sequences_follow_the_mix_over_files_of_unequal_size(spark, tmp_path):
    from rankloom.llm.mixing import mix

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(50, 800))), "en", f"s{min(i % 8, 3)}", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cuts = (0, 10, 40, 700, 720, 1200)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        docs.where(f"doc_id >= {low} and doc_id < {high}").coalesce(1).write.parquet(f"{tmp_path}/mixed/part={k}")
    mixed = spark.read.parquet(*[f"{tmp_path}/mixed/part={k}" for k in range(5)])
    place = {r.doc_id: (r.mix_slot, r.mix_at) for r in mix(mixed).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = defaultdict(list)
        for r in corpus_pipeline.pack(spark, mixed, str(tmp_path)).collect():
            tasks[r.sequence_id >> 32].append(place[r.doc_id])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = [tasks[t] for t in sorted(tasks)]
    assert len(own) > 1 and all(max(x) < min(y) for x, y in zip(own, own[1:]))


def test_workers_hold_little(spark):
    """A stage's batches are bounded in bytes, whatever the length of the texts, and what a worker kept for another stage goes."""
    encoder(tokenizer_path("word_bpe_49k.json"), 150_000).encode_one("river stone")
    assert worker_cache("encoders")
    give_back()
    assert not worker_cache("encoders")
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('river stone cloud ', 3000) AS text", "'en' AS lang", "'s' AS source", "54000L AS n_chars")
    corpus_pipeline.identify_languages(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    got = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["bytes"] for r in got) < 5 << 20
