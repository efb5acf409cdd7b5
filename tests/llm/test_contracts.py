"""The corpus operators against plain versions, on awkward rows: nulls, blanks, ties, repeats, long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewire.llm import cluster, importance, language_id, license_scan, media, mixing, quality_rules, queries, sentencepiece, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> dict[int, str | None]:
    draw = random.Random(1)
    vocabulary = ["tide", "Wire", "harbour", "été", "x#1", "licence", "the", "of", "sea", "MIT", "License,", "naïve", "日本"]
    prose = lambda n: " ".join(draw.choice(vocabulary) + str(draw.randrange(40)) for _ in range(n))
    passage, other = prose(70), prose(55)
    out: dict[int, str | None] = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "two words"}
    out |= {6: f"{prose(30)} {passage} {prose(20)}", 7: f"{passage}\n{prose(60)}", 8: f"{prose(10)} {passage} {other}", 9: f"{other} {passage}"}
    out |= {10: prose(200), 12: f"{prose(5)} {passage} {passage}", 13: "spam " * 400, 14: "a b c d e f g h i\n" * 30, 15: prose(6000)}
    out[11] = out[10]
    out[16] = out[10].replace("tide", "ebb", 1)
    out |= {17: "the MIT\nLicense, and the GNU General Public License; CC-BY", 18: "cc by cc by Apache license"}
    out[19] = out[17]
    return out


def frame(spark, docs=None):
    docs = texts() if docs is None else docs
    rows = [(k, t, "en" if k % 2 else "fr", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, t in docs.items()]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, docs):
    return spark.createDataFrame([(k, int(k not in (13, 14)), int(k == 13)) for k in docs], "doc_id long, quality int, toxic int")


def compare(found, columns, want):
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in found.collect()}
    assert got == want


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = texts()
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    labels(spark, docs).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_op1(spark, tables):
    compare(queries.op1_substring_dedup(spark, tables), ["n_words", "n_removed", "kept_sha256"], brute.repeats(texts()))


def test_op4(spark, tables):
    want = {k: brute.stored(t) for k, t in texts().items()}
    compare(queries.op4_media(spark, tables), ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"], want)


def test_op6_round_trip_and_the_models_own_ids(spark, tables):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=queries.PIECES)
    rows = queries.op6_sentencepiece(spark, tables).collect()
    assert all(r["same"] for r in rows)
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: model.encode(t or "") for k, t in texts().items()}


def test_op7(spark, tables):
    want = {k: brute.statistics(t) for k, t in texts().items()}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    compare(queries.op7_quality_rules(spark, tables), columns, want)


def test_op8(spark, tables):
    prints = {k: brute.fingerprint(t) for k, t in texts().items()}
    roots = brute.linked(prints)
    compare(queries.op8_simhash(spark, tables), ["fingerprint", "component_id"], {k: (f"{p:016x}", roots[k]) for k, p in prints.items()})


def test_op9(spark, tables):
    rows = queries.op9_mixing(spark, tables).collect()
    source = {k: None if k % 5 == 0 else f"s{k % 3}" for k in texts()}
    sizes = {k: len(brute.words(t)) for k, t in texts().items()}
    whole: dict = {}
    for k, n in sizes.items():
        whole[source[k]] = whole.get(source[k], 0) + n
    aims = brute.targets(whole)
    for r in rows:
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], whole[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(aims[source[r["doc_id"]]], abs=1e-5)
        assert r["taken"] <= 3 * r["size"]
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_mixing(spark, tables).collect()))


def test_op10(spark, tables):
    want = {k: brute.licenses(t) for k, t in texts().items()}
    compare(queries.op10_license_scan(spark, tables), ["n_words", "n_base", "first_word", "last_word", "base_labels"], want)


def test_op10_finds_a_passage_with_words_left_out(spark):
    text = "x " * 50 + license_scan.PASSAGES[0][1].replace("free of charge", "") + " y" * 50
    row = license_scan.scan(frame(spark, {1: text})).first()
    assert "mit" in {s["label"] for s in row["spans"]} and not any(s["exact"] for s in row["spans"])


def test_near_copies_by_five_words(spark):
    draw = random.Random(2)
    base = [str(draw.randrange(10**6)) for _ in range(400)]
    other = [str(draw.randrange(10**6)) for _ in range(400)]
    near = [*base[:200], "new", *base[201:]]
    docs = {1: " ".join(base), 2: " ".join(near), 3: " ".join(other), 4: " ".join([*base[:100], *other[100:]]), 5: " ".join(base).upper()}
    found = {r["id"]: r["component"] for r in simhash.near_copies(frame(spark, docs)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def near_the_threshold() -> dict[int, str]:
    """Texts around one template, in families whose members are a little more or less than 0.8 similar."""
    draw = random.Random(5)
    own = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    template = own(120)
    out = []
    for _ in range(50):
        tail = own(40)
        out.append([*template, *tail])
        out += [[*template, *tail[: 40 - k], *own(k + more)] for k, more in ((draw.randrange(10, 26), draw.randrange(3)) for _ in range(3))]
    # Chains, of which each link alone is near, and exactly 0.8: 8 of 10 shingles.
    chain = own(140)
    out += [chain[k : k + 100] for k in range(0, 41, 5)]
    exact = own(13)
    out += [exact, exact[:12], exact[:11], [*exact[:5], "x", *exact[6:]]]
    draw.shuffle(out)
    return {i: " ".join(x) for i, x in enumerate(out)}


def test_near_copies_are_those_of_all_pairs(spark):
    docs = near_the_threshold()
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in docs.items()}
    want = {i: i for i in docs}
    near = [(a, b) for a in docs for b in docs if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 20 and len(near) < len(docs) * 5
    for _ in docs:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert {r["id"]: r["component"] for r in simhash.near_copies(frame(spark, docs)).collect()} == want


def test_pairs_are_whole(spark):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for x in list(prints)[:30]:
        prints.add(x ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    rows = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    want = {tuple(sorted((simhash.signed(a), simhash.signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in simhash.near_pairs(rows).collect()} == want


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["node"]: r["root"] for r in cluster.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


@pytest.mark.parametrize("edges_a_part", [250_000, 7])
def test_rounds_of_components_take_few_tasks(spark, monkeypatch, edges_a_part):
    monkeypatch.setattr(cluster, "EDGES", edges_a_part)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context, group = spark.sparkContext, f"components of {edges_a_part}"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(90, i) for i in range(70, 90)], "a int, b int")
        got = {r["node"]: r["root"] for r in cluster.components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(1, 61)} | {i: 70 for i in range(71, 91)}
    track = context.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup(group)]
    stages = [track.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
    tasks = sum(s.numTasks for s in stages if s and s.numCompletedTasks)
    # The first distinct and its count; rounds have a task a step where the edges fit one part.
    assert edges_a_part == 7 or 0 < tasks < 200


def test_media_inside(spark):
    inner = media.bitmap(bytes(192 * 2))
    rows = spark.createDataFrame([(1, bytearray(b"head" + inner), "image/png"), (2, bytearray(inner), "text/plain"), (3, None, None), (4, bytearray(b"BM no"), None)], "id int, data binary, kind string")
    found = {r["id"]: (r["type"], [(e["type"], e["start"], e["length"]) for e in r["embedded"]]) for r in media.sniff(rows, type_col="kind").collect()}
    assert found[2] == ("image/bmp", []) and found[3] == (None, []) and found[4] == ("text/plain", [])
    assert found[1][1] == [("image/bmp", 4, len(inner))]


def test_unknown_language_and_bounds(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op2_language_id(spark, tables).collect()}
    assert rows.keys() == texts().keys()
    assert {k for k, r in rows.items() if r["lang_pred"] == "und"} >= {1, 2, 3}
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_and_importance_give_every_row(spark, tables):
    scored = queries.op3_toxicity(spark, tables).collect()
    assert {r["doc_id"] for r in scored} == set(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    sampled = queries.op5_importance(spark, tables).collect()
    assert {r["doc_id"] for r in sampled} == set(texts())
    assert sum(r["kept"] for r in sampled) == round(17 / 19 * 19)


def awkward(spark):
    """Null ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, "a b c " * 30, "en", None, 1, 1), (1, None, None, "s", 2, 2), (1, None, None, "s", 2, 2), (2, "a b c " * 30, "en", "s", 3, 3)]
    return spark.createDataFrame(rows, SCHEMA + ", words int")


@pytest.mark.parametrize("empty", [False, True])
def test_nulls_repeats_and_empty_tables(spark, empty):
    docs = awkward(spark)
    docs = docs.limit(0) if empty else docs
    known = labels(spark, [1, 2]).limit(0 if empty else 9)
    n = 0 if empty else 4
    model = sentencepiece.Model.load(queries.PIECES)
    yes = F.col("doc_id").isNotNull()
    assert substring_dedup.dedup(docs).count() == n
    assert language_id.identify(docs, yes).count() == n
    assert toxicity.score(docs, known, F.lit(True)).count() == n
    assert media.stored(docs).count() == n
    assert importance.resample(docs, known).count() == n
    assert sentencepiece.decode(sentencepiece.encode(docs, model), model).count() == n
    assert quality_rules.judge(docs, known)[0].count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert license_scan.scan(docs).count() == n


@pytest.mark.parametrize("docs", [None, {}])
def test_pipeline_keeps_columns(spark, tmp_path, docs):
    data = frame(spark, docs)
    data.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, texts()).write.parquet(f"{tmp_path}/labels.parquet")
    now = data
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cluster.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == data.columns
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.columns == ["doc_id", "ids", "n_pieces", "same"] and last.count() == now.count()
    assert last.where("NOT same").isEmpty()
