"""Each operator against its plain version: on awkward rows, and on the smallest tables."""

import random
import zlib

import pyarrow as pa
import pytest

from skerry.llm import chat, components, contamination, langid, mixing, native, near, pii, repeats, rules, shards, store, substrings, suffixes, textkit
from skerry.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm import brute

CLASH = "doc_id long, text string, lang string, source string, n_chars long, own string, found string, v string, rep long, n_words string, shard string, h string, total string"


@pytest.fixture(scope="module")
def passage():
    rng = random.Random(5)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))


@pytest.fixture(scope="module")
def texts(passage):
    """Nulls, empties, ties, copies, repeats and a very long text."""
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["one", "Two", "three\n", "vier", "été", "x#|"]) + str(rng.randrange(400)) for _ in range(n))
    long_ = some(20_000)
    base = some(80)
    edited = base.replace("one", "uno", 2)
    return [None, "", "   \n\t", "word", "two words", base, base, edited, base + " end", "a " + passage + " b", "c d " + passage[:600] + " e", long_, "x y z " * 60, "Same line here now\n" * 12, some(40) + "\x0b" + passage, None, "word"]


@pytest.fixture(scope="module")
def rows(texts):
    return [(k, t, ["en", "de", None][k % 3], ["s1", "s2", None][k % 3], None, "o", None, "v", 7, None, None, "h", "t") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(table):
    return [(r.doc_id, r.text) for r in table.collect()]


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(spark, docs, texts, passage, none, table, pairs):
    bench = [(1, passage), (2, "WORD"), (10, " ".join(passage.split()[40:60])), (3, None), (4, "..."), (None, "two words"), (5, "two  words!")]
    items = spark.createDataFrame(bench, "item_id int, text string")
    want = sorted(brute.contamination(enumerate(texts), [b for b in bench if b[0] is not None]))
    assert got(contamination.report(docs, items), *CONTAMINATION) == want
    kept = contamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in want if not r[-1]]
    assert contamination.report(none, items).count() == 0
    assert got(contamination.report(docs, items.where("false")), "doc_id", "n_hit") == [(k, 0) for k in range(len(texts))]
    blocks = contamination.annotate(docs.select("doc_id", "text"), items, block_bytes=400)
    assert len(list(contamination._blocks(items, 13, 400))) > 1
    assert sorted((r.own.doc_id, len(r.found["items"])) for r in blocks.collect()) == [(r[0], r[3]) for r in want]
    real = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(QUERIES["op1_suffix_arrays"](spark, SF), *CONTAMINATION) == sorted(brute.contamination(pairs, real))


def test_a_large_benchmark_is_taken_a_block_at_a_time(spark, docs, texts, passage, monkeypatch):
    """The pass with a block is written before the next block is sent."""
    bench = [(k, " ".join(passage.split()[3 * k : 3 * k + 20])) for k in range(30)] + [(99, passage * 5)]
    items = spark.createDataFrame(bench + bench, "item_id int, text string")
    events = []
    made, kept = contamination.block_of, contamination.written
    monkeypatch.setattr(contamination, "block_of", lambda *a: (b := made(*a)) and events.append("block") or b)
    monkeypatch.setattr(contamination, "written", lambda *a: events.append("pass") or kept(*a))
    found = contamination.annotate(docs.select("doc_id", "text"), items, block_bytes=1000)
    assert events.count("block") > 3 and events == ["block"] + ["block", "pass"] * (events.count("block") - 1)
    want = brute.contamination(enumerate(texts), bench)
    assert sorted((r.own.doc_id, r.found["n_words"], sum(s.end - s.start for s in r.found["spans"]), len(r.found["items"])) for r in found.collect()) == sorted(w[:4] for w in want)


def test_suffix_arrays_against_sorting():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, kinds in ((0, 2), (1, 2), (50, 2), (400, 3), (400, 300)):
        v = np.append(rng.integers(0, kinds + 1, n), 0)
        tails = [(v[k : k + 1 + int(np.flatnonzero(v[k:] == 0)[0])].tolist(), k) for k in np.flatnonzero(v)]
        assert contamination.suffix_array(v, n + 1).tolist() == [k for _, k in sorted(tails)]
        capped = contamination.suffix_array(v, 4)
        assert [v[k : k + 4].tolist() for k in capped if 0 not in v[k : k + 4]] == sorted(t[:4] for t, _ in tails if len(t) > 4)


def test_longest_match_is_located(spark, passage):
    words = passage.split()
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[10:50]) + " z")], "doc_id long, text string")
    r = contamination.report(docs, spark.createDataFrame([("a", passage)], "item_id string, text string")).first()
    assert (r.longest_match, r.longest_start, r.longest_item) == (40, 2, "a")


def test_shards(spark, docs, texts, none, table, pairs):
    for n in (1, 2, 16, 17, 100):
        keys = spark.range(300)
        assert got(keys.select("id", shards.jump_shard(keys["id"], n).alias("s")), "id", "s") == [(k, brute.jump(brute.md5_key(k), n)) for k in range(300)]
    out = shards.assign(docs, 4, bin_rows=2).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out if r.text_crc32 is not None) == sorted((k, len(t.encode()) + 1, zlib.crc32(t.encode()), brute.jump(brute.md5_key(k), 4), brute.jump(brute.md5_key(k), 5)) for k, t in enumerate(texts) if t is not None)
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    moved = [r for r in out if r.shard != r.grown_shard]
    assert all(r.grown_shard == 4 for r in moved)
    assert shards.assign(none).count() == 0
    twice = shards.assign(docs.unionByName(docs).withColumn("doc_id", docs["doc_id"] % 3), 4).collect()
    assert len(twice) == 2 * len(texts)
    for s in range(4):
        slots = sorted(r.slot for r in twice if r.shard == s)
        assert slots == list(range(len(slots)))
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.slot for r in shards.assign(nulls, 4).collect()) == [0, 1]
    whole = QUERIES["op2_jump_shards"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in whole) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode()), brute.jump(brute.md5_key(d), 16)) for d, t in pairs)


def test_language_id(spark, docs, none, table):
    held = QUERIES["op3_subword_langid"](spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = held.join(lang, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.98 * len(both)
    assert sum(r.rejected for r in both) <= 0.01 * len(both)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    out = {r.doc_id: r for r in langid.report(docs, model).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out.values())
    assert [out[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and all(out[k].rejected for k in (0, 1, 2))
    assert {out[k].held_out for k in out} == {True, False}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out)
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.report(none, model).count() == 0
    unlearned = langid.report(docs.withColumn("lang", docs["own"].substr(9, 1)).withColumn("lang", docs["found"])).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_rare_language_is_learned_from_pieces_anywhere(spark, monkeypatch):
    """Twelve rows in 2,012 are learned though the sample is of 20 rows, and pieces begin at any character."""
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(texts=texts, labels=labels))
    common = [(k, " ".join(f"{'ab'[k % 2]}{k}x{j}" for j in range(40)), ("aa", "bb")[k % 2]) for k in range(2000)]
    rows = [*common, *[(k, f"rare words {k}", "zz") for k in range(2000, 2012)]]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 60)
    want = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(2000, 2012))
    assert seen["labels"].count("zz") == want > 0 and len(seen["labels"]) <= 20 + 3 * langid.LANGUAGE_ROWS
    assert all(any(t in text for _, text, _ in rows) for t in seen["texts"])
    assert sum(any(text.startswith(t) for _, text, _ in rows) for t in seen["texts"]) < len(seen["texts"]) / 2


def test_language_scores_against_a_plain_version(table, pairs):
    model = langid.fit(table)
    out = {r.doc_id: r for r in langid.report(table, model).collect()}
    for d, t in pairs[::7]:
        p = brute.language_scores(t, model)
        assert out[d].score == pytest.approx(max(p), abs=1e-6) and out[d].lang_pred == model.languages[p.index(max(p))]


def test_the_floor_is_calibrated(spark):
    """It is the least score with few wrong rows above it, and never costs more right rows than allowed."""
    import numpy as np

    right, wrong = np.zeros(101, int), np.zeros(101, int)
    right[90], right[50], wrong[40], wrong[50] = 9_000, 1_000, 200, 5
    assert langid.floor_of(right, wrong) == 0.50
    right[30] = 4  # under LOST of the right rows
    assert langid.floor_of(right, wrong) == 0.50
    wrong[:] = 0
    assert langid.floor_of(right, wrong) == 0.50 and langid.floor_of(0 * right, wrong) == 0.0
    right[20] = 100
    assert langid.floor_of(right, wrong) == 0.20


def test_predictions_see_only_the_text(spark, table):
    model = langid.fit(table)
    other = table.selectExpr("doc_id + 1000 AS doc_id", "text", "'zz' AS lang", "null AS source")
    assert [x[1:] for x in got(langid.report(table, model), "doc_id", "lang_pred", "score")] == [x[1:] for x in got(langid.report(other, model), "doc_id", "lang_pred", "score")]


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("short", [1, 16])
def test_near_duplicates(spark, docs, texts, table, pairs, monkeypatch, short):
    """A short list of one sends all that is shared through hubs."""
    monkeypatch.setattr(near, "SHORT_LIST", short)
    assert got(near.report(docs), *NEAR) == sorted(brute.components(list(enumerate(texts))))
    assert got(near.report(table), *NEAR) == sorted(brute.components(pairs))


def test_near_duplicates_of_a_whole_table(spark):
    """Every document of sf0.01 against every other: no link is lost."""
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = [(r.doc_id, brute.shingles(r.text)) for r in whole.collect()]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, sizes = {}, dict((d, len(s)) for d, s in sets)
    for d, s in sets:
        met = {}
        for v in s:
            for e in holders.setdefault(v, []):
                met[e] = met.get(e, 0) + 1
            holders[v].append(d)
        for e, shared in met.items():
            if 100 * shared >= 75 * (len(s) + sizes[e] - shared):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    assert got(near.report(whole), *NEAR) == sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def test_near_duplicates_in_chains_and_crowds(spark, monkeypatch):
    """Groups in which each text is like the next but not like the one after that, and unlike texts with a shared passage."""
    monkeypatch.setattr(near, "SHORT_LIST", 2)
    rng = random.Random(3)
    shared = [f"w{k}" for k in range(40)]
    made = []
    for g in range(6):
        base = [f"g{g}x{k}" for k in range(60)]
        for step in range(8):
            made.append(" ".join(base + shared if g % 2 else base))
            for _ in range(1):
                base[rng.randrange(60)] = f"e{g}.{step}"
    made += [" ".join(shared + [f"u{k}.{j}" for j in range(8)]) for k in range(30)]
    rng.shuffle(made)
    rows = list(enumerate(made))
    out = near.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, *NEAR) == sorted(brute.components(rows))


def test_a_hub_settles_members_whose_short_sketches_share_little(spark, monkeypatch):
    """The hub and the last have a Jaccard of 1/2 and 6 of 32 values; the one between is linked with both, and leaves with the hub."""
    monkeypatch.setattr(near, "SHORT_LIST", 1)
    words = [f"s6304w{k}" for k in range(404)]
    others = [(k, f"other text of number {k}") for k in range(3, 23)]  # so that the list is long
    texts = spark.createDataFrame([(0, " ".join(words[:304])), (1, " ".join(words)), (2, " ".join(words[100:])), *others], "doc_id long, text string")
    with store.scratch(spark):
        classes, deep = (near.sketched(texts, most).withColumnRenamed("doc_id", "rep") for most in (near.ESTIMATE, near.DEEP))
        members = classes.selectExpr("7L AS v", "rep", "n", "true AS indexed")
        links = near._hub_links(members, classes, deep, texts, spark.createDataFrame([], "a long, b long"))
        assert {(r.a, r.b) for r in links.collect()} == {(0, 1), (1, 2)}


def _mixed_crowd(seed, x, y, at):
    """A text of 251 shingles, one of more than a sketch's that extends it, and 50 that hold four of its five blocks each."""
    base = [f"s{seed}p{i}" for i in range(255)]
    rows = [(at, " ".join(base)), (at + 900, " ".join(base + [f"s{seed}b{i}" for i in range(x)]))]
    for k in range(50):
        cut = 51 * (k % 5)
        rows.append((at + 1 + k, " ".join(base[:cut] + base[cut + 51 :] + [f"s{seed}d{k}.{i}" for i in range(y)])))
    return rows


def test_links_between_sets_on_either_side_of_a_sketch(spark):
    """Ten crowds in which the one pair of near duplicates has 251 shingles on one side and over 256 on the other."""
    rows = [r for seed in range(10) for x, y in ((80, 124), (76, 134)) for r in _mixed_crowd(f"{seed}.{x}.", x, y, 1000 * (2 * seed + (x == 76)))]
    rows += _mixed_crowd(1, 80, 124, 50_000) + _mixed_crowd(4, 76, 134, 60_000)
    out = near.report(spark.createDataFrame(rows, "doc_id long, text string"))
    crowds = [[r for r in rows if r[0] // 1000 == k] for k in sorted({d // 1000 for d, _ in rows})]
    assert got(out, *NEAR) == sorted(c for crowd in crowds for c in brute.components(crowd))


def test_stars_and_lists_are_dealt_to_many_tasks(spark, monkeypatch):
    """A hub's pairs and a long list's blocks go to many cells, and nothing is lost."""
    monkeypatch.setattr(near, "CELL_WORK", 500)
    monkeypatch.setattr(near, "CROSS_ROWS", 4)
    monkeypatch.setattr(near, "SHORT_LIST", 2)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 20] + [f"x{k}.{j}" for j in range(k % 7)])) for k in range(60)]
    assert got(near.report(spark.createDataFrame(rows, "doc_id long, text string")), *NEAR) == sorted(brute.components(rows))


def test_near_duplicates_keep_own_columns_and_rows_without_id(spark, docs, none):
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in near.report(docs).collect() if r.kept)
    assert near.report(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near.report(odd).collect()} == {(None, None, True), (3, 3, True)}
    assert near.deduplicated(odd).count() == 4


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (202, 201)]
    found = components.roots(spark.createDataFrame(links, "a long, b long"))
    want = [(k, 0) for k in range(1, 41)] + [(100, 0), (201, 200), (202, 200)]
    assert got(found, "node", "root") == want
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, docs, none, table):
    out = mixing.report(table)
    by = {r.doc_id: r for r in out.collect()}
    src = {r.doc_id: r.source for r in table.collect()}
    sizes, taken, target, most = {}, {}, {}, {}
    for d, r in by.items():
        s = src[d]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        most[s] = max(most.get(s, 0), r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size >= r["size"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    capped, whole = set(), 1.5 * sum(sizes.values())
    while True:
        rest, over = whole - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and rest * weight[s] / over > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert target[s] == pytest.approx(2 * sizes[s] if s in capped else rest * weight[s] / over)
        assert abs(taken[s] - target[s]) <= most[s]
    assert got(out, "doc_id", "taken") == got(mixing.report(table.repartition(5)), "doc_id", "taken")
    small = mixing.report(docs)
    assert small.count() == docs.count() and mixing.report(none).count() == 0
    assert {r.taken for r in small.where("size = 0").collect()} == {0}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in small.collect())
    twice = table.unionByName(table)
    assert mixing.report(twice).count() == 2 * table.count() and mixing.mixed(twice).count() == sum(r.copies for r in mixing.report(twice).collect())


def test_copies_are_counted_out(spark, monkeypatch):
    monkeypatch.setattr(native, "RUN", 3)
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10)], "x string, n long")
    assert got(native.counted_out(rows, "n", "at"), "x", "at") == [(x, k) for x, n in (("a", 1), ("b", 3), ("c", 10)) for k in range(n)]


def test_tables_are_deleted_by_their_own_scope(spark):
    """Scopes of two threads, and scopes within scopes, delete what was written in them and nothing else."""
    import os
    import threading

    seen, paths = {}, {}

    def work(name, first, second):
        with store.scratch(spark):
            first.wait()
            paths[name] = store.written(spark.range(3), name).inputFiles()[0]
            kept = store.written(spark.range(4), name, keep=True)
            second.wait()
            seen[name] = spark.read.parquet(paths[name]).count()
        seen[name + " after"] = kept.count()

    gates = threading.Barrier(2), threading.Barrier(2)
    threads = [threading.Thread(target=work, args=(n, *gates)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen["one after"] == seen["two after"] == 4 and not any(os.path.exists(p.removeprefix("file://")) for p in paths.values())


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.shared_dir(Session())


def test_cube_in_small_blocks(spark, table):
    """Levels of blocks: what blocks leave open is balanced again, and both totals stay near."""
    out = mixing.choose(table.withColumn("source", table["lang"].substr(1, 0)), block_rows=16, share=0.7).collect()
    words, rows = sum(r["size"] for r in out), len(out)
    assert abs(sum(r["size"] * r.total for r in out) - 0.7 * words) < 0.02 * words
    assert abs(sum(r.total for r in out) - 0.7 * rows) < 0.1 * rows


PII = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _personal(d, t):
    spans = brute.personal(t or "")
    return (d, *(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


def test_personal_data(spark, docs, texts, none, table, pairs):
    rng = random.Random(2)
    parts = ["1", "2", "34", ".", " ", "@", "a", "b-", "+", "(555)", "-", "4111111111111111", "x@y.z", "%", "..", "1.2.3.4", "256", "é", " at ", " dot "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t in made:
        assert pii.base_spans(t) == brute.personal(t)
    assert got(pii.report(docs), *PII) == sorted(_personal(k, t) for k, t in enumerate(texts))
    assert pii.report(none).count() == 0
    assert got(QUERIES["op7_weak_pii"](spark, SF), *PII) == sorted(_personal(d, t) for d, t in pairs)


def test_weak_supervision_adds_spans_and_keeps_base(spark):
    known = ["mail me: ann@site.org", "call +1 (555) 010-7788 now", "card 4111 1111 1111 1111 ok", "server 10.0.0.1 up"]
    loose = ["phone (555) 010-7788 today", "tel 555-010-7799", "contact ann [at] site [dot] com", "ssn 123-45-6789", "no phone"]
    rows = list(enumerate(known * 5 + loose * 3))
    out = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "email:9:21" and out[20] == "phone:6:20" and out[23] == "id:4:15"
    red = pii.redacted(spark.createDataFrame([(0, "a 10.0.0.1, b x@y.zz."), (1, None), (2, "none")], "doc_id long, text string"))
    assert [r.text for r in red.orderBy("doc_id").collect()] == ["a <ip>, b <email>.", None, "none"]


def _planted(rng, many):
    """Texts that each hold one loose value, and whether it is personal."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    area = lambda: rng.choice("23456789") + digits(2)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    real = [
        lambda: f"call {area()}-{area()}-{digits(4)}", lambda: f"tel ({area()}) {area()}-{digits(4)}", lambda: f"contact {name()} [at] {name()} [dot] com",
        lambda: f"ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f'token = "{hexes(40)}"', lambda: f"api_key: AKIA{hexes(16).upper()}",
        lambda: f'password = "{hexes(14)}"',
    ]
    other = [
        lambda: f"part {area()}-{area()}-{digits(4)}", lambda: f"order 9{digits(2)}-{digits(2)}-{digits(4)}", lambda: f"meet {name()} at {name()} dot {name()}qzx",
        lambda: f"commit {hexes(40)}", lambda: f"md5 {hexes(32)}", lambda: f"invoice 1{digits(2)} {digits(3)} {digits(4)} units", lambda: f"build release_candidate-{digits(2)}", lambda: f"version {digits(14)}",
    ]
    out = []
    for k in range(many):
        good = k % 2 == 0
        value = rng.choice(real if good else other)()
        out.append((k, f"{name()} {name()}, {value} {name()} {name()}.", good))
    return out


def test_candidates_keep_apart():
    """Digits within a key are no card of their own, a key that holds a base card is still a key, and nothing is cut out of an address."""
    key = "7c06284de91015a3697474879429345dd8a"
    assert pii.candidates(f"token = {key}") == [("secret", 8, 8 + len(key), False)]
    held = "ab4111111111111111cd"
    assert pii.candidates(held) == [("card", 2, 18, True), ("secret", 0, 20, False)]
    assert [s[0] for s in pii.candidates("to x@mail7example1host2.com or 2669109448945250.")] == ["email", "card"]
    for text in (key, held, "a1" * 9 + " " + "4111 1111 1111 1111", "555-234-9876 555-234-9877"):
        spans = sorted((a, b) for _, a, b, base in pii.candidates(text) if not base)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_added_spans_on_held_out_plants(spark):
    """The classifier, fitted without labels on one half, on values of the other half that it never saw."""
    rng = random.Random(8)
    seen, held = _planted(rng, 1500), _planted(rng, 600)
    model = pii.fit(spark.createDataFrame([r[:2] for r in seen], "doc_id long, text string"))
    out = pii.annotate(spark.createDataFrame([r[:2] for r in held], "doc_id long, text string"), model).collect()
    good = {r[0]: r[2] for r in held}
    flagged = {r.own.doc_id for r in out if r.spans}
    right = sum(good[d] for d in flagged)
    assert right >= 0.95 * len(flagged) and right >= 0.95 * sum(good.values()), (right, len(flagged), sum(good.values()))


def test_labelers_reliabilities_are_found():
    """Votes drawn from known tables: EM finds each labeler's rates and the share of personal data."""
    rng = random.Random(6)
    rates, counts, truth = [(0.9, 0.8), (0.6, 0.3), (0.7, 0.7), (0.3, 0.6), (0.5, 0.5)], {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        vote = tuple((1 if rng.random() < hit else 0) if y else (-1 if rng.random() < deny else 0) for hit, deny in rates)
        c = pii.code("phone", vote)
        counts[c] = counts.get(c, 0) + 1
        truth.setdefault(c, []).append(y)
    belief, found = pii.aggregate(counts)
    for (hit, deny), name in zip(rates, pii.LABELERS, strict=True):
        assert found["phone", name] == pytest.approx((hit, deny), abs=0.05)
    assert sum(belief[c] * n for c, n in counts.items()) == pytest.approx(8_000, rel=0.05)
    assert all(pii.decode(pii.code(k, v)) == (k, v) for k in pii.KINDS for v in ((1, 0, -1, 1, 0), (-1, -1, -1, -1, -1)))


def test_no_text_takes_long(spark):
    for t in ("a" * 200_000 + "@", "1" * 100_000, "1." * 100_000, "+1" + "-" * 100_000, "@" * 100_000, "a.b@" * 30_000, "555-555-5555 " * 20_000, "a1-" * 100_000):
        pii.candidates(t)


def test_chat(spark, none):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<", "|", ">", "\\", "/s>", "[", "INST]", "<<SYS>>", "<</SYS>>", "<|end|>", " ", "a", "role:", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "system", "tool", "", text])
        formatted, a, b = chat.turn_text(role, text)
        assert chat.unescape(formatted[a:b]) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert chat.parse(formatted + chat.turn_text("user", text)[0]) == [(role, text), ("user", text)]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, "user", "hi"), (4, 5, None, "r"), (4, 1, "tool", "</s>"), (None, 0, "user", "x"), (5, 0, "user", "hi"), (5, 1, "assistant", "yes")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat.pack(turns.coalesce(1)).collect()
    assert sum(t.text.count("hi") for t in trees) < 4  # shared turns stand once a tree
    for t in trees:
        for n in t.nodes:
            above = sum(s.end - s.start for s in n.attends)
            assert n.position == above
    out = {r.conv_id: r for r in chat.digests(chat.pack(turns, most=2)).collect()}
    assert len(out) == 6 and out[2].n_turns == 3 and out[2].loss_chars == 2 and out[2].loss_sha256 == brute.sha("no")
    assert out[4].turns_sha256 == brute.sha("tool\n</s>\n\nr\n") and out[4].loss_sha256 == brute.sha("")
    assert chat.digests(chat.pack(turns.where("false"))).count() == 0


def _digest(turns):
    """What digests() says of a conversation, from the template's words alone."""
    loss = "".join(x for r, x in turns if r == "assistant")
    size = sum(len(chat.escape(x)) + {"system": 15, "user": 18, "assistant": 6}.get(r, 16 + len(chat.escape(r))) for r, x in turns)
    return len(turns), brute.sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), brute.sha(loss), size


def test_chat_with_long_repeated_and_deep_conversations(spark):
    """Conversations part at any depth; in sorted runs all that share turns meet, so a run of trees holds few more nodes than turns differ."""
    rng = random.Random(12)
    shared = [("user" if k % 2 == 0 else "assistant", f"turn {k} [INST]") for k in range(12)]
    made = {c: shared[: rng.randrange(1, 12)] + [("assistant", f"end {c % 40}")] for c in range(300)}
    made[300] = [("user", "long " * 20_000), ("assistant", "x" * 50_000)]
    made[301] = [("tool</s>", "a"), ("", "b"), ("assistant", "")]
    rows = [(c, k, r, x, 1, "n", "p") for c, turns in made.items() for k, (r, x) in enumerate(turns)]
    rows += [(302, 0, "user", "twice", 1, "n", "p")] * 2 + [(None, 0, "user", "x", 1, "n", "p"), (None, 0, "user", "x", 2, "n", "p"), (None, None, None, None, 3, None, None)]
    made[302] = [("user", "twice")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int, nodes string, path string").repartition(5)
    trees = chat.pack(turns, most=64, chars=20_000).collect()
    got_ = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.pack(turns, most=64, chars=20_000)).collect() if r.conv_id is not None}
    assert got_ == {c: _digest(t) for c, t in made.items()}
    assert sum(leaf.conv_id is None for t in trees for leaf in t.leaves) == 3
    assert max(len(t.leaves) for t in trees) <= 64 and all(len(t.positions) == len(t.text) for t in trees)
    distinct = {tuple(t[:k]) for c, t in made.items() for k in range(1, len(t) + 1)}
    assert sum(len(t.nodes) for t in trees) <= len(distinct) + 13 * len(trees)


def test_chat_over_the_table(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op8_prefix_tree"](spark, SF).collect()} == {c: _digest(t) for c, t in want.items()}


RULES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_rules(spark, docs, texts, none, table, pairs):
    assert got(rules.measure(docs), *RULES) == sorted((k, *brute.measures(t)) for k, t in enumerate(texts))
    out = {r.doc_id: r for r in QUERIES["op9_rule_ledger"](spark, SF).collect()}
    for d, t in pairs:
        n, *_, repeated = m = brute.measures(t)
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.base_failed and r.kept)
    assert rules.ledger(none).count() == 0
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    book = rules.ledger(docs)
    report = {r.rule: r for r in rules.ablations(book).collect()}
    assert docs.count() - report["few_words"].n_rejected == kept.count()
    assert report["few_words"].n_failed == sum(brute.measures(t)[0] < 10 for t in texts)
    assert {r.n_failed for r in rules.ablations(rules.ledger(none)).collect()} == {0}


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_substrings(spark, docs, texts, none, table, pairs, monkeypatch, size):
    """Small chunks and buckets make every exchange cross tasks."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
    monkeypatch.setattr(repeats, "BUCKET_WORDS", size // 10)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substrings.report(docs), *columns) == sorted(brute.without_repeats(enumerate(texts), 35))
    assert substrings.report(none).count() == 0
    assert got(suffixes.spans(docs), "doc_id", "start", "end", "n_words") == sorted(brute.repeated_spans(list(enumerate(texts)), 50))
    assert suffixes.spans(none).count() == 0
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 100 * size)
    assert got(substrings.report(table), *columns) == sorted(brute.without_repeats(pairs, 35))
    assert got(suffixes.spans(table), "doc_id", "start", "end", "n_words") == sorted(brute.repeated_spans(pairs, 50))


def test_suffix_matches_grow_to_both_sides(spark, docs, texts, table, pairs, monkeypatch):
    """The neighbour that shares most to the right shares nothing to the left: another one does. Hot passages give the same by another way."""
    rng = random.Random(31)
    w = [f"m{k}" for k in range(60)]
    other = lambda n: [f"{rng.choice('pqrst')}{rng.randrange(10 ** 6)}" for _ in range(n)]
    made = [" ".join(other(5) + w[a:b] + other(7)) for a, b in [(0, 60), (0, 51), (0, 50), (9, 60), (10, 60), (11, 60), (5, 55), (0, 49), (20, 60), (3, 40)] * 2 for _ in range(2)]
    made = [t for k, t in enumerate(made) if k % 3 or k > 30]
    made.append(" ".join(w + other(3) + w))  # twice in one text
    rows = list(enumerate(made))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, 0):
        monkeypatch.setattr(repeats, "HOT_CHUNKS", hot)
        for size in (300, 1 << 20):
            monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
            monkeypatch.setattr(repeats, "BUCKET_WORDS", size // 10)
            assert got(suffixes.spans(frame), "doc_id", "start", "end", "n_words") == sorted(brute.repeated_spans(rows, 50))
    seen = suffixes._steps(50, 8, 32, False)(1)
    left = pa.table({"chunk": [0] * len(made), "doc_id": list(range(len(made))), "text": made})
    keys, at, _ = suffixes._anchors(50, 8, 32)(textkit.words(left["text"]))
    told = pa.table({"chunk": pa.array([0], pa.int32()), "keys": [repeats._packed(keys)]})
    sent = seen[0]((pa.scalar(0),), left, told)
    answers = seen[1]((pa.scalar(0),), sent)
    for turned in (left, left.take(list(reversed(range(len(made)))))):  # a chunk's texts may arrive in any order
        out = seen[2]((pa.scalar(0),), turned, answers)
        assert sorted(zip(*(out[c].to_pylist() for c in out.column_names), strict=True)) == sorted(brute.repeated_spans(rows, 50))
    alone = spark.createDataFrame([(None, made[-1]), (None, "a"), (None, None)], "doc_id long, text string")
    assert suffixes.spans(alone).count() == 0 and suffixes.spans(alone, within=True).count() == 2


def test_buckets_are_filled_evenly(table):
    """The fullest of many buckets holds less than one and a half times the mean, of suffixes as of blocks."""
    import numpy as np

    w = textkit.words(pa.array([r.text for r in table.select("text").collect()] * 3))
    w.hash[:] = textkit.mix(w.hash + np.arange(len(w.hash), dtype=np.uint64))  # as if all words differed
    for anchors in (suffixes._anchors(50, 8, 32), substrings._anchors(18)):
        keys, *_ = anchors(w)
        for buckets in (8, 32):
            bucket = (keys[0].astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(int)
            assert np.bincount(bucket, minlength=buckets).max() <= 1.5 * len(bucket) / buckets


def test_kept_text(spark):
    one = " ".join(f"w{k}" for k in range(40))
    out = substrings.removed(spark.createDataFrame([(1, f"a  {one} b"), (2, one), (3, "c")], "doc_id long, text string"))
    assert got(out, "doc_id", "n_removed", "text") == [(1, 40, "a b"), (2, 40, ""), (3, 0, "c")]


def test_rows_without_ids_and_rows_that_share_one(spark, passage):
    """Null and repeated doc_ids, null and empty texts, and columns with the operators' own names: each row is judged by itself."""
    mail = "write to ann@site.org or call +1 (555) 010-7788 " + passage
    texts = [(None, passage), (None, "a b"), (None, None), (7, passage), (7, passage), (7, mail), (8, ""), (9, None)]
    rows = [(d, t, "en", "s", 1, "o", "f", "v", 2, "n", "sh", "h", "t") for d, t in texts]
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    order = lambda xs: sorted(xs, key=repr)
    many = lambda df, *columns: order(tuple(r[c] for c in columns) for r in df.collect())
    bench = [("b", " ".join(passage.split()[5:30]))]
    items = spark.createDataFrame(bench, "item_id string, text string")
    assert many(contamination.report(docs, items), *CONTAMINATION) == order(brute.contamination(texts, bench))
    assert contamination.decontaminate(docs, items).columns == docs.columns
    assert many(substrings.report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == order(brute.without_repeats(texts, 35))
    assert many(suffixes.spans(docs), "doc_id", "start", "end", "n_words") == order(brute.repeated_spans(texts, 50))
    assert many(rules.measure(docs), *RULES) == order((d, *brute.measures(t)) for d, t in texts)
    assert rules.filtered(docs).columns == docs.columns
    assert many(pii.report(docs), *PII) == order(_personal(d, t) for d, t in texts)
    assert pii.redacted(docs).columns == docs.columns
    found = langid.report(docs)
    assert many(found, "doc_id", "held_out") == order((d, zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) for d, _ in texts)
    assert shards.shard_column(docs).columns == [*docs.columns, "shard_"] and shards.assign(docs, 4).count() == len(texts)
    assert mixing.report(docs).count() == len(texts) and mixing.mixed(docs).columns == docs.columns


def test_words_of_columns():
    w = textkit.words(pa.array(["  a\x0bb", None, "", "c"]))
    assert w.counts.tolist() == [2, 0, 0, 1] and len(set(w.hash.tolist())) == 3
    assert textkit.words(pa.array([], pa.string())).counts.tolist() == []
