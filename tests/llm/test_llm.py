"""The dealt operators against brute force, round trips, held-out data and awkward inputs."""

import collections
import os
import random
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commentarium.llm import abuse, clusters, languages, leaks, lookalikes, near_copies, pii, registry, terms, tokens, topn
from commentarium.tables import distinct_fans, load

TEXTS = "id string, text string, extra int, term string, key string, v string"


def frame(spark, rows):
    """Texts with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], TEXTS)


AWKWARD = [("a", None), (None, "some text without an id"), ("b", ""), ("c", "   "), ("d", "word " * 30_000), ("e", "same text"), ("e", "same text"), ("f", "x" * 50_000)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, check_sql):
    check_sql(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs_without_repeats(name, spark, small):
    rows = [str(r) for r in registry.queries()[name](spark, small).collect()]
    assert len(rows) == len(set(rows))


# 1 terms


def lists(spark, rows):
    return spark.createDataFrame([(r, "clash") for r in rows], "terms array<string>, term string")


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_terms_against_brute_force(spark, limit):
    rng = random.Random(1)
    rows = [[f"t{rng.randrange(300)}" for _ in range(rng.randrange(30))] for _ in range(400)] + [None, [], ["a", None, ""]]
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(lists(spark, rows), "terms", limit).collect()}
    occ, rec = collections.Counter(), collections.Counter()
    for r in rows:
        words = [w for w in r or [] if w is not None]
        occ.update(words)
        rec.update(set(words))
    assert got == {w: (occ[w], rec[w]) for w in occ}


def test_terms_of_nothing(spark):
    assert terms.term_counts(lists(spark, []), "terms").count() == 0


def test_marks(spark):
    rows = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 90, 10), ("d", 90, 9)], "term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in terms.marked(rows, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


# 2 clusters


def blobs(spark, sizes, seed=3, extra=()):
    rng = np.random.default_rng(seed)
    centres = [(0, 0), (8, 0), (0, 8), (8, 8)]
    rows = [(f"p{k}-{i:05d}", float(x), float(y), "clash") for k, n in enumerate(sizes) for i, (x, y) in enumerate(rng.normal(centres[k], 0.4, (n, 2)))]
    return spark.createDataFrame(rows + list(extra), "who string, x double, y double, id string")


def test_clusters_found(spark):
    rows = blobs(spark, (600, 200, 60), extra=[("far", 40.0, -40.0, ""), (None, 0.0, 0.0, ""), ("p0-00000", 0.0, 0.0, "")])
    got = {r["id"]: r["leader_id"] for r in clusters.similarity_clusters(rows, "who", ["x", "y"], []).collect()}
    assert "far" not in got and set(got.values()) == {"p0-00000", "p1-00000", "p2-00000"}
    assert all(i.split("-")[0] == leader.split("-")[0] for i, leader in got.items()) and len(got) >= 850


def test_local_join_holds_few_pairs():
    rng = np.random.default_rng(5)
    n, size = 5_000, 20
    v = rng.normal(size=(n * size, 4))
    members = pa.StructArray.from_arrays(
        [pa.array([f"f{k}" for k in range(n * size)]), pa.ListArray.from_arrays(pa.array(np.arange(n * size + 1) * 4, pa.int32()), pa.array(v.ravel())), pa.array(np.full(n * size, np.inf))], names=["m", "v", "r"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), members)
    batch = pa.RecordBatch.from_arrays([lists], names=["ms"])
    before, found = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for out in clusters._local_join(iter([batch])):
        found += out.num_rows
        assert pa.total_allocated_bytes() - before < 40_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * size * (size - 1) and peak < 60_000_000


def divided(spark, pairs):
    both = [(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])]
    edges = spark.createDataFrame(both, "a string, b string, w double").groupBy("a", "b").agg({"w": "sum"}).toDF("a", "b", "w")
    return {r["id"]: r["community"] for r in clusters.communities(edges).collect()}


def test_communities_that_components_join(spark):
    rng = random.Random(6)
    near = {(f"{g}{i:02d}", f"{g}{j:02d}") for g in "xyz" for i in range(30) for j in rng.sample(range(30), 5) if i != j}
    got = divided(spark, near | {("x00", "y00"), ("x01", "y01"), ("y02", "z02")})  # one connected component
    assert len(set(got.values())) == 3 and all(len({c for i, c in got.items() if i[0] == g}) == 1 for g in "xyz")


def test_communities_of_one_and_of_separate_groups(spark):
    rng = random.Random(7)
    near = {(f"{g}{i:02d}", f"{g}{j:02d}") for g in "xy" for i in range(40) for j in rng.sample(range(40), 6) if i != j}
    assert len(set(divided(spark, {p for p in near if p[0][0] == "x"}).values())) == 1
    assert len(set(divided(spark, near).values())) == 2
    assert len(set(divided(spark, {("a", "b")}).values())) == 1


def test_typical_members(spark):
    rows = spark.createDataFrame([("a", "a", 1.0), ("b", "a", 3.0), ("c", "a", 3.0), ("z", "z", 0.0)], "id string, leader_id string, degree double")
    assert {r["leader_id"]: (r["size"], r["typical"]) for r in clusters.described(rows, 2).collect()} == {"a": (3, ["b", "c"]), "z": (1, ["z"])}


def test_neighbour_recall(spark):
    points = clusters.standardised(blobs(spark, (900, 300)), ["x", "y"], [], "who").cache()
    ids, v = zip(*[(r["id"], r["v"]) for r in points.collect()])
    v = np.array(v)
    got = collections.defaultdict(set)
    for r in clusters.neighbour_graph(points).collect():
        got[r["id"]].add(r["nid"])
    hits = 0
    for k in range(0, len(ids), 10):
        d = ((v - v[k]) ** 2).sum(axis=1)
        d[k] = np.inf
        hits += len(got[ids[k]] & {ids[j] for j in np.argsort(d)[: clusters.NEIGHBOURS]})
    assert hits / (len(range(0, len(ids), 10)) * clusters.NEIGHBOURS) >= 0.9


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_neighbour_recall_on_fans(spark):
    rows = distinct_fans(load(spark, "/root/testdata/sf0.01", "fans"))
    points = clusters.standardised(rows, clusters.FEATURES, clusters.COUNTS, "author_channel_id").cache()
    ids, v = zip(*[(r["id"], r["v"]) for r in points.collect()])
    v, hits = np.array(v), 0
    got = {r["id"]: set(r["n"]) for r in clusters.neighbour_graph(points).groupBy("id").agg({"nid": "collect_set"}).toDF("id", "n").collect()}
    for k in range(0, len(ids), 100):
        d = ((v - v[k]) ** 2).sum(axis=1)
        d[k] = np.inf
        hits += len(got[ids[k]] & {ids[j] for j in np.argsort(d)[: clusters.NEIGHBOURS]})
    assert hits / (len(range(0, len(ids), 100)) * clusters.NEIGHBOURS) >= 0.9


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 1.0, "")], [("a", None, None, "")] * 3 + [("b", 1.0, None, "")]])
def test_clusters_of_little(spark, rows):
    assert clusters.similarity_clusters(spark.createDataFrame(rows, "who string, x double, y double, id string"), "who", ["x", "y"], ["x"]).count() == 0


# 3 near copies


def edited(rng, words):
    words = list(words)
    for _ in range(3):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [words[k], f"new{rng.randrange(99)}"], [f"other{rng.randrange(99)}"]])
    cut = rng.randrange(len(words))
    return words[cut:] + words[:cut] if rng.random() < 0.3 else words


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for k in range(150):
        base = [f"w{rng.randrange(3000)}" if rng.random() < 0.5 else f"the{rng.randrange(20)}" for _ in range(rng.randrange(25, 70))]
        texts += [" ".join(edited(rng, base) if c else base) for c in range(rng.choice([1, 1, 2, 4]))]
    rows = [(f"i{k:04d}", t) for k, t in enumerate(texts)] + [("i0000", texts[0]), ("zz", texts[0].upper()), (None, texts[0]), ("n", None), ("m", "")]
    got = {tuple(r) for r in near_copies.near_copies(frame(spark, rows), "id", "text").collect()}
    bags = {i: collections.Counter(re.findall(r"\w+", t.lower())) for i, t in rows if i and t}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= 30}
    want = set()
    for a in bags:
        for b in bags:
            if a < b:
                both = sum((bags[a] & bags[b]).values())
                if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.7:
                    want.add((a, b))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGEST_BUCKET", 3)
    base = [f"w{k}" for k in range(40)]
    rows = [(f"i{k}", " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(12)]
    texts, _ = near_copies.classes_of_copies(frame(spark, rows), "id", "text", 30)
    batch = texts.toArrow().combine_chunks().to_batches()[0]
    keys = np.repeat(7, batch.num_rows)
    import pyarrow as pa

    out = list(near_copies._paired(iter([pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0)], names=["key", "rid"])])))
    assert sum(b.num_rows for b in out) == 12 and all(b.column(1).null_count == b.num_rows for b in out)
    name = near_copies.frequency_file(texts)
    shared = list(near_copies._rare_prefixes(name, 0.7)(iter([batch])))[0]
    held = collections.defaultdict(set)
    for key, rid in zip(shared.column(0).to_pylist(), shared.column(1).to_pylist()):
        held[rid].add(key)
    assert all(held[a] & held[b] for a in held for b in held)


@pytest.mark.parametrize("step", [7, 1000])
def test_full_buckets_give_only_pairs_that_may_be_alike(spark, step):
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(10_000)}" for _ in range(40)) for _ in range(400)]
    rows = [(f"i{k:03d}", t) for k, t in enumerate(texts)] + [("z0", texts[0] + " more"), ("z9", texts[399] + " more")]
    classes, _ = near_copies.classes_of_copies(frame(spark, rows), "id", "text", 30)
    table = classes.toArrow().combine_chunks()
    columns = [pa.array(np.repeat(7, len(table))), *(table[c].combine_chunks() for c in ("rid", "n", "m1", "m2"))]
    one = pa.RecordBatch.from_arrays(columns, names=["key", "rid", "n", "m1", "m2"])
    before = one.slice(0, 3).set_column(0, "key", pa.array([5, 5, 6]))
    out = list(near_copies._paired(iter([before, *(one.slice(k, step) for k in range(0, len(table), step))])))
    got = {tuple(sorted(p)) for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert {("i000", "z0"), ("i399", "z9")} <= got and len(got) < 400


def test_only_keys_of_several_rows_are_kept():
    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    for step in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + step]), pa.array([str(i) for i in range(k, min(k + step, 10))])], names=["key", "rid"]) for k in range(0, 10, step)]
        assert [x for b in near_copies._met_often(iter(batches)) for x in b.column(1).to_pylist()] == ["1", "2", "4", "5", "6", "8", "9"]


def test_pairs_of_ids_with_several_texts_come_once(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [("a", " ".join(words)), ("a", " ".join([*words, "x"])), ("b", " ".join([*words, "y"])), ("b", " ".join(words)), ("c", " ".join(words))]
    assert sorted(tuple(r) for r in near_copies.near_copies(frame(spark, rows), "id", "text").collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_alignment():
    a = np.array([[1, 2, 3, 4, 5, 0], [1, 2, 3, 4, 5, 6]], dtype=np.uint64)
    b = np.array([[1, 3, 4, 9, 5, 0], [6, 5, 4, 3, 2, 1]], dtype=np.uint64)
    assert near_copies.aligned_words(a, np.array([5, 6]), b, np.array([5, 6])).tolist() == [4, 1]


@pytest.mark.parametrize("rows", [[], AWKWARD])
def test_near_copies_of_awkward_texts(spark, rows):
    assert near_copies.near_copies(frame(spark, rows), "id", "text").count() == 0


def test_alignment_decides_and_counting_helps_moved_parts(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [("a", " ".join(words)), ("b", " ".join([*words[:20], "new", *words[20:]])), ("c", " ".join([*words[20:], "other", *words[:20]])), ("d", " ".join(words[:20] * 2))]
    texts, _ = near_copies.classes_of_copies(frame(spark, rows), "id", "text", 30)
    got = {(r["a"], r["b"]): (round(r["share"], 3), r["aligned"]) for r in near_copies.similar_classes(texts).collect()}
    assert got[("a", "b")] == (round(40 / 41, 3), round(40 / 41, 4)) and ("a", "d") not in got
    assert got[("b", "c")][0] == round(40 / 42, 3) and got[("b", "c")][1] < 0.6


def test_classes_count_links_without_pairing_copies(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(f"a{k:03d}", " ".join(words)) for k in range(300)] + [("b", " ".join(words[:-1])), ("z", "w " * 35), ("s", "short text"), ("n", None), (None, " ".join(words))]
    got = {r["id"]: (r["class_id"], r["links"]) for r in near_copies.near_copy_classes(frame(spark, rows), "id", "text").collect()}
    assert len(got) == 302 and got["a007"] == ("a000", 300) and got["b"] == ("b", 300) and got["z"] == ("z", 0)
    assert near_copies.near_copy_classes(frame(spark, []), "id", "text").count() == 0


# 4 abuse


@pytest.fixture(scope="module")
def abuse_model(spark, small):
    rows = [(r["text"], r["label"]) for r in load(spark, small, "abuse_labels").orderBy("example_id").collect()]
    clean = [r["text"] for r in load(spark, small, "language_samples").orderBy("sample_id").collect()]
    phrases = abuse.common_phrases(load(spark, small, "comments"), "text")
    return rows, abuse.train([r for k, r in enumerate(rows) if k % 5], clean, phrases)


def test_abuse_on_held_out_examples(abuse_model):
    rows, model = abuse_model
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    scores = abuse.Scorer(model).score([t for t, _ in held])
    guess = np.where(scores.max(axis=1) >= abuse.THRESHOLD, scores.argmax(axis=1) + 1, 0)
    truth = np.array([abuse.CLASSES.index(y) for _, y in held])
    assert (guess == truth).mean() >= 0.8


UNSHOWN = {
    "abusive": ["cierra el pico, eres un cobarde y un inútil", "dich sollte man verprügeln, du elender feigling", "somebody should punch you, you lousy coward", "ti spacco le gambe, verme schifoso", "tu n'es qu'un lâche et un minable"],
    "hateful": ["those Tessarines are thieves and criminals, get them out of our country", "les Drosks sont des animaux, dehors", "ненавижу этих мигрантов, вон отсюда", "i hate Velmarians, they are filth", "os Ostari são lixo, odeio todos"],
    "sexual": ["zieh dich aus und komm in mein bett", "take off your clothes and come to bed with me", "quiero tocar todo tu cuerpo desnudo", "j'ai envie de coucher avec toi ce soir", "naked girls on my cam tonight"],
}


UNSHOWN_KINDS = {
    "abusive": ["somebody ought to whip Torvela until there is blood", "Narmaris ought to be kicked with heavy boots", "niemand braucht so einen wie dich, geh sterben du feigling", "прикрой свой рот, тупой урод", "I hope Wexford chokes on that cake"],
    "hateful": ["Velmarians poison all that is good in this town", "expel the Drosks, expel them today", "die Ostari haben bei anständigen leuten nichts zu suchen", "i Tessarines non devono stare con le persone per bene", "exterminate them, a week without Morrowfolk would be nice"],
    "sexual": ["the nasty things i would love to do to you, Torvela", "uncensored films of Narmaris, very explicit", "come upstairs with me and slip out of that dress slowly", "monte dans ma chambre et enlève ta robe", "vem para o meu quarto e tira a roupa toda"],
}


def test_abuse_in_wordings_that_no_label_shows(abuse_model):
    texts = [(t, y) for y, block in UNSHOWN.items() for t in block]
    scores = abuse.Scorer(abuse_model[1]).score([t for t, _ in texts])
    found = [s.max() >= abuse.THRESHOLD and abuse.CATEGORIES[s.argmax()] == y for s, (_, y) in zip(scores, texts)]
    assert np.mean(found) >= 0.75


@pytest.mark.parametrize("text", ["thank you so much, you are wonderful", "grazie a tutti", "saludos a Torvela, Narmaris, Wexford y Belnor", "the Tessarines win the battle at the end of this book"])
def test_harmless_remarks_are_not_found(abuse_model, text):
    assert abuse.Scorer(abuse_model[1]).score([text]).max() < abuse.THRESHOLD


def test_abuse_of_more_kinds_in_wordings_that_no_label_shows(abuse_model):
    texts = [(t, y) for y, block in UNSHOWN_KINDS.items() for t in block]
    scores = abuse.Scorer(abuse_model[1]).score([t for t, _ in texts])
    found = [s.max() >= abuse.THRESHOLD and abuse.CATEGORIES[s.argmax()] == y for s, (_, y) in zip(scores, texts)]
    assert np.mean(found) >= 0.75


@pytest.mark.parametrize("text", ["I", "my", "Me!", "#Dunkania", "The Ostari and the Drosks of this game have lovely armor"])
def test_single_words_and_groups_in_games_are_not_found(abuse_model, text):
    assert abuse.Scorer(abuse_model[1]).score([text]).max() < abuse.THRESHOLD


def test_several_categories_of_one_text(abuse_model):
    rows, model = abuse_model
    one = {y: next(t for t, label in rows if label == y and "Tavgaris" not in t) for y in ("hateful", "sexual")}
    alone = abuse.Scorer(model).score([one["hateful"], one["sexual"]])
    both = abuse.Scorer(model).score([f"{one['hateful']}. {one['sexual']}!"])[0]
    assert np.allclose(both, alone.max(axis=0))


def test_common_phrases_against_brute_force(spark):
    texts = [f"Thank you all for the {n} kind words. So good" for n in range(40)] + [None, "", "rare words are not common at all"]
    got = abuse.common_phrases(frame(spark, [(str(k), t) for k, t in enumerate(texts)]), "text")
    assert got == ["all for the 0", "so good", "thank you all for", "the 0 kind words"]
    assert abuse.common_phrases(frame(spark, []), "text") == []


def test_nothing_to_learn_from():
    assert abuse.train([], [], []).shape == (abuse.BUCKETS + 1, len(abuse.CLASSES))
    assert abuse.Scorer(abuse.train([("you fool", "abusive"), ("a fine day", "none")], [], [])).score(["", "you fool"]).shape == (2, 3)


def test_disguises():
    assert abuse.tokens("you i d i o t") == ["you", "idiot"] and abuse.tokens("p_a_r_a_s_i_t_e") == ["parasite"]
    assert abuse.tokens("vermmmmmin") == ["vermin"] and abuse.tokens("g31l") == ["geil"] and abuse.tokens("do a b test") == ["do", "a", "b", "test"]


def test_abuse_scores_of_awkward_texts(spark, abuse_model):
    got = abuse.abuse_scores(frame(spark, AWKWARD), "id", "text", abuse_model[1])
    assert got.count() == len(AWKWARD) and got.filter("id = 'a'").first()["abusive"] == 0.0
    assert abuse.abuse_scores(frame(spark, []), "id", "text", abuse_model[1]).count() == 0


# 5 top n


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), f"i{rng.randrange(400)}", 5) for _ in range(3000)] + [("c", 1, None, 5)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, "g string, s bigint, i string, salt int"), "g", "s", "i", 4)
    want = []
    for g in "abc":
        want += sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2] is None, r[2]))[:4]
    assert got.columns == ["g", "s", "i", "salt"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, s bigint, i string")
    assert topn.top_n_per_group(empty, "g", "s", "i", 3).count() == 0 and topn.top_n_per_group(empty, "g", "s", "i", 0).count() == 0


# 6 look-alikes


@pytest.mark.parametrize(
    "text, plain, kinds",
    [
        ("ｆｕｌｌ１", "full1", {"form"}), ("ﬁne", "fine", {"form"}), ("𝐛𝐨𝐥𝐝", "bold", {"form"}), ("café", "café", {"accent"}), ("a​b", "ab", {"invisible"}),
        ("a b", "a b", {"blank"}), ("frоm", "from", {"script"}), ("Βeltath", "Beltath", {"script"}), ("Вeлов", "Велов", {"script"}), ("уеаr", "year", {"script"}),
        ("привет", "привет", set()), ("👩‍💻 ❤️ 🏳️‍🌈 1️⃣", "👩‍💻 ❤️ 🏳️‍🌈 1️⃣", set()), ("line\nend\r\n", "line\nend\r\n", set()),
        ("мир peace", "мир peace", set()), ("", "", set()), ("ok？", "ok?", {"punctuation"}), ("été", "été", set()),
    ],
)
def test_rewriting(text, plain, kinds):
    assert lookalikes.Rewriter({}).rewrite(text) == (plain, kinds)


def test_rewriting_twice_changes_nothing():
    rewriter = lookalikes.Rewriter({"a": 5, "é": 3})
    for text in ("ｆｕｌｌ ｃａｆé", "café ﬁn", "Βelt​ath　x"):
        once = rewriter.rewrite(text)[0]
        assert rewriter.rewrite(once) == (once, set())


def test_consistent_forms_of_awkward_values(spark):
    got = lookalikes.consistent_forms(frame(spark, [*AWKWARD, ("g", "ｘ" * 40_000)]), "id", ["text", "term"]).collect()
    assert [(r["id"], r["field_name"], len(r["plain"])) for r in got] == [("g", "text", 40_000)]
    assert lookalikes.consistent_forms(frame(spark, []), "id", ["text"]).count() == 0


@pytest.mark.parametrize("text", ["Hauptstr. 5, da", "ул. Ленина, д. 5: да", "Calle Mayor, n. 12b. Avda. Sol 4", "at 12 Oak Street. 14 Elm St", "end.12 rue de la Paix", "C/ Sol, nº 4", "5 bis rue l’Eau\n6 rue du Lac", "no digits on Oak Street"])
def test_addresses_in_stretches_are_those_of_the_whole_text(text):
    for whole in (text, "so. " + text, text + "! then " + text):
        assert [m.span() for m in pii._addresses(whole)] == [m.span() for m in pii.ADDRESS.finditer(whole)]


def test_nothing_that_is_rewritten_misses_the_first_look(spark):
    """Every character of the first planes outside the large blocks, by itself and beside letters of several scripts."""
    points = [p for p in (*range(0x80, 0x3400), 0x4E00, 0xAC00, *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1F300)) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs")]
    rewriter = lookalikes.Rewriter({})
    changed = [v for p in points for v in (chr(p), "a" + chr(p), chr(p) + "a", "я" + chr(p), chr(p) + "λ", "日" + chr(p), chr(p) + "1a") if rewriter.rewrite(v)[1]]
    rows = spark.createDataFrame(pa.table({"v": changed}))
    assert len(changed) > 10_000 and rows.filter(~F.col("v").rlike(lookalikes.suspect())).count() == 0
    plain = spark.createDataFrame([(v,) for v in ("plain words, 12 of them", "été où ça", "просто текст", "απλό κείμενο", "普通の文", "한국어", "nice 👍🏽")], "v string")
    assert plain.filter(F.col("v").rlike(lookalikes.suspect())).count() <= 1  # skin tones combine with nothing, prolonged sounds may


@pytest.mark.parametrize("text", ["Ⓜ️ and ℹ️", "㊗️ 🈁", "tree 🎄"])
def test_emoji_are_no_forms(text):
    assert lookalikes.Rewriter({}).rewrite(text) == (text, set())


@pytest.mark.parametrize("word", ["\u0430\u0562\u0433\u0434", "\u03b1\u0532\u03b3", "\uab70\u043b\u043e"])
def test_words_of_two_other_scripts_are_cases(spark, word):
    got = lookalikes.consistent_forms(spark.createDataFrame([("a", f"so {word} it is")], "i string, t string"), "i", ["t"]).collect()
    assert [r["kinds"] for r in got] == [["script"]]


def test_look_alike_classes_are_transitive():
    c = lookalikes.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        c.union(a, b)
    assert c.find("a") == c.find("d")


# 7 languages


@pytest.fixture(scope="module")
def language_model(spark, small):
    rows = [(r["lang"], r["text"]) for r in load(spark, small, "language_samples").orderBy("sample_id").collect()]
    held = [r for k, r in enumerate(rows) if k % 4 == 0]
    return languages.train([r for k, r in enumerate(rows) if k % 4], languages.read_pieces(os.path.join(languages.TOKENIZER_DIR, languages.PIECE_FILE))), held


def found(spark, model, rows):
    return [r.asDict() for r in languages.segments(frame(spark, rows), "id", "text", model).orderBy("id", "first_word").collect()]


def test_languages_on_held_out_samples(spark, language_model):
    model, held = language_model
    got = collections.defaultdict(set)
    for r in found(spark, model, [(str(k), t) for k, (_, t) in enumerate(held)]):
        if r["main"]:
            got[r["id"]].add(r["lang"])
    assert sum(got[str(k)] == {lang} for k, (lang, _) in enumerate(held)) / len(held) >= 0.95


def test_mixed_text_is_divided(spark, language_model):
    model, held = language_model
    by = dict(held)
    got = [r for r in found(spark, model, [("m", f"{by['en']} {by['es']} {by['ru']}")]) if r["words"] >= languages.SENTENCE_WORDS]
    assert [r["lang"] for r in got] == ["en", "es", "ru"] and all(0.5 < r["confidence"] <= 1 for r in got)


def test_forward_sums_all_segmentations():
    pieces = languages.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab"])
    prob = np.array([[0.1], [0.2], [0.3], [0.1], [0.05], [0.02]])
    alpha = languages.forward(languages._codes(["ab"]), pieces, prob, 0.0)
    assert abs(alpha[0, 3, 0] - (0.1 * 0.3 * 0.1 + 0.1 * 0.05 + 0.2 * 0.1 + 0.02)) < 1e-12


def test_words_as_they_are_scored():
    assert [languages.normal_word(t) for t in "Ｃａｆé, wоrk #tag 12:30 ok! @some.one http://a.b".split()] == ["café", "work", "", "", "ok", "", ""]
    assert languages.split_words("you v e r s a g e r y a mi") == ["you", *["0"] * 10, "mi"]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("en", "EN-us", "English", "por", "pt_BR", "unknown", "", None, "tl")], "l string")
    assert [r[0] for r in rows.select(languages.label_code("l")).collect()] == ["en", "en", "en", "pt", "pt", None, None, None, None]


def test_languages_of_awkward_texts(spark, language_model):
    assert {r["id"] for r in found(spark, language_model[0], AWKWARD)} <= {None, "d", "e", "f"}
    assert found(spark, language_model[0], []) == []


def test_every_comment_has_a_language_or_none(spark, small):
    rows = load(spark, small, "comments").filter("comment_id IS NOT NULL").select("comment_id", "cleaned_text").distinct()
    got = collections.defaultdict(list)
    for x in languages.p7_segments(spark, small).collect():
        got[x["comment_id"]].append(x)
    texts = {x["comment_id"]: x["cleaned_text"] or "" for x in rows.collect()}
    assert set(got) == set(texts)
    short = [k for k, t in texts.items() if t.isascii() and len(t) < languages.MIN_CHARS and t.replace(" ", "").isalpha()]
    assert short and all(x["lang"] and x["confidence"] > 0 for k in short for x in got[k])


def test_weak_words_and_no_words(spark, language_model):
    weak = found(spark, language_model[0], [("w", "zq xkvw"), ("n", "12:30 !!")])
    assert weak and {x["id"] for x in weak} == {"w"} and all(x["lang"] and 0 < x["confidence"] < 1 for x in weak)
    every = languages.segments(frame(spark, [("n", "12:30 !!"), ("z", None)]), "id", "text", language_model[0], every=True).collect()
    assert sorted((x["id"], x["lang"], x["confidence"]) for x in every) == [("n", None, 0.0), ("z", None, 0.0)]


# 8 tokens

TOKENIZER = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json")


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public vocabularies here")
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(TOKENIZER)
    public.encode_special_tokens = True
    rng = random.Random(4)
    made = ["".join(rng.choice("ab é\n\t  '日😀9.<|>x") for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = [("s", "<|endoftext|> is text"), ("t", "it's  what   we'll \r\n see"), *AWKWARD, *((f"m{k}", t) for k, t in enumerate(made))]
    got = sorted((str(r["id"]), r["ids"]) for r in tokens.encode_corpus(frame(spark, rows), "id", "text", lexicon_words=300).collect())
    assert got == sorted((str(i), public.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    assert tokens.encode_corpus(frame(spark, []), "id", "text").count() == 0


def test_transducer_numbers_and_ids():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"abc": 257}
    words = [b"abc", b"ab", b"b", b"xabc", b"yabc", b""]
    t = tokens.Transducer(tokens.build_transducer([w for w in words if w], ranks))
    assert t.numbers([*words, b"abcd", b"q"]).tolist() == [1, 0, 2, 3, 4, -1, -1, -1]
    assert [x.tolist() for x in tokens.encode_words([b"xabc", b"zab"], t, ranks)] == [[120, 257], [122, 256]]


def test_suffixes_are_shared():
    ranks = {bytes([k]): k for k in range(256)}
    data = tokens.build_transducer([b"%cationally" % c for c in range(97, 123)], ranks)
    assert data[1] == 11  # one path of states for 26 words


# 9 leaks


def test_leaks(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    words = passage.split()
    docs = [
        ("whole", f"x {passage} y"), ("marked", " > ".join(f"**{w.upper()}**" for w in words[3:15])), ("short", " ".join(words[3:14])), ("gap", " ".join([*words[:11], "zz", *words[11:22]])),
        ("common", "the of and"), *AWKWARD,
    ]
    items = spark.createDataFrame([(1, passage, "x"), (2, "too short", "y"), (None, passage, "z"), (3, None, "z")], "item int, passage string, id string")
    got = leaks.phrase_matches(frame(spark, docs), items, "id", "text", "item", "passage").collect()
    assert {(r["id"], r["item"], r["longest_run"], r["covered_share"]) for r in got} == {("whole", 1, 30, 1.0), ("marked", 1, 12, 0.4), ("gap", 1, 11, 0.7333)}
    assert leaks.phrase_matches(frame(spark, []), items, "id", "text", "item", "passage").count() == 0


def test_proximity_does_not_depend_on_the_place(spark):
    words = [f"p{k}" for k in range(40)]
    parts = [*words[:11], "x", "y", *words[11:22], "z", *words[22:33]]
    docs = [(f"d{k}", " ".join(["other"] * k + parts)) for k in range(8)] + [("far", " ".join([*words[:11], *["x"] * 20, *words[11:22], *["y"] * 20, *words[22:33]]))]
    items = spark.createDataFrame([(1, " ".join(words))], "item int, passage string")
    got = {r["id"]: (r["longest_run"], r["covered_share"]) for r in leaks.phrase_matches(frame(spark, docs), items, "id", "text", "item", "passage").collect()}
    assert got == {f"d{k}": (11, 0.825) for k in range(8)}


# 10 personal information


def test_patterns():
    text = "Mail a.b+c@host.example, d_e (at) host (dot) test or F AT g DOT example; call +44 7700 900 154, (617) 555-0114 or 01 99 00 58 42. Id 900-12-3456, ZZ 0501 893, 00123456-K. At 7 Oak Street, Lindenweg 3a."
    got = collections.defaultdict(set)
    for kind, a, b, value in pii.patterned(text):
        assert text[a:b]
        got[kind].add(value)
    assert got["email"] == {"a.b+c@host.example", "d_e@host.test", "f@g.example"}
    assert got["phone"] == {"447700900154", "6175550114", "0199005842"} and got["id_number"] == {"900123456", "zz0501893", "00123456k"}
    assert got["address"] == {"7 oak street", "lindenweg 3a"}


def test_other_numbers_are_no_findings():
    text = "Build 2.12.555.168 on 2024-03-12 or 12/03/2024, ISBN 978-0-00-65-1, order 00-4471-855, ticket 4471-0293-43, 1920x1080, ping admin@localhost, Oak Street Sessions 406, 555:0241"
    assert list(pii.patterned(text)) == []


NAMES = [("1", "My name is Nora Wexhurst and I sing"), ("2", "Name: Wexhurst, Laura"), ("3", "Zorblat Wexhurst and ZORBLAT QUILLSON came"), ("4", "Laura M. Quillson wrote to me"), ("5", "Rose Garden is a level"), ("6", "Nora Quillson")]


def test_names_are_learned_from_the_corpus(spark):
    given = spark.createDataFrame([("Nora",), ("Laura",), ("Rose",), (None,)], "given_name string")
    got = {(r["id"], r["pii_value"]) for r in pii.find_pii(frame(spark, [*NAMES, *AWKWARD]), "id", "text", given, "given_name").collect() if r["pii_kind"] == "name"}
    assert got == {("1", "nora wexhurst"), ("2", "laura wexhurst"), ("3", "zorblat wexhurst"), ("3", "zorblat quillson"), ("4", "laura quillson"), ("6", "nora quillson")}


def test_replacing_keeps_the_rest(spark):
    given = spark.createDataFrame([("Nora",), ("Laura",)], "given_name string")
    rows = [*NAMES, ("7", "call 617-555-0114 or (617) 555-0114, ask nora.w@host.example"), ("8", None), ("9", "nothing here")]
    got = {r["id"]: r for r in pii.replace_pii(frame(spark, rows), "id", "text", given, "given_name", "k").collect()}
    assert got["1"]["placeholders"] == "My name is [NAME] and I sing" and got["9"]["surrogates"] == "nothing here" and got["8"]["placeholders"] is None
    assert got["7"]["placeholders"] == "call [PHONE] or [PHONE], ask [EMAIL]"
    numbers = re.findall(r"[\d()][\d() -]+\d", got["7"]["surrogates"])
    assert re.sub(r"\D", "", numbers[0]) == re.sub(r"\D", "", numbers[1]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", numbers[0])
    assert "Wexhurst" not in got["1"]["surrogates"] and got["1"]["surrogates"].startswith("My name is ")


FOUND = "pii_kind string, pii_value string, given string, family string"


def surrogates(spark, rows, givens=("nora", "laura", "петр", "анна"), key="k"):
    got = pii.assign_surrogates(spark.createDataFrame(rows, FOUND), key, list(givens)).collect()
    assert len(got) == len({(r["pii_kind"], r["pii_value"]) for r in got})
    return {(r["pii_kind"], r["pii_value"]): r["surrogate"] for r in got}


def person(given, family):
    return "name", f"{given} {family}", given, family


def test_no_two_surrogates_are_alike_even_in_an_exhausted_form(spark):
    rows = [("id_number", f"{k:04d}", None, None) for k in range(9_000)] + [("phone", f"01{k:03d}", None, None) for k in range(1_000)]
    rows += [person(f"g{k % 30}a", f"f{k}") for k in range(200)]
    a, b = surrogates(spark, rows), surrogates(spark, rows)
    assert a == b and len(a) == len(rows) and len({(k[0], s) for k, s in a.items()}) == len(rows)
    real = {(k, v) for k, v, _, _ in rows}
    assert not real & {(k[0], s) for k, s in a.items()} and surrogates(spark, rows[-5:], key="other") != surrogates(spark, rows[-5:])


def test_surrogates_keep_script_ending_and_coreference(spark):
    got = surrogates(spark, [person("анна", "петрова"), person("nora", "wexhurst"), person("laura", "wexhurst"), ("email", "nora.wexhurst@host.example", None, None), ("address", "улица Садовая, 5", None, None)])
    assert re.fullmatch("[а-я-]+ [а-я]+", got["name", "анна петрова"]) and "анна" in got["name", "анна петрова"]
    nora, laura = got["name", "nora wexhurst"].split(), got["name", "laura wexhurst"].split()
    assert nora[1] == laura[1] and nora[0] != laura[0] and got["email", "nora.wexhurst@host.example"].startswith(".".join(nora) + "@")
    assert not re.search("[a-z]", got["address", "улица Садовая, 5"]) and got["address", "улица Садовая, 5"].startswith("улица ")


def test_pii_of_nothing(spark):
    none = spark.createDataFrame([], "given_name string")
    assert pii.find_pii(frame(spark, []), "id", "text", none, "given_name").count() == 0
    assert pii.replace_pii(frame(spark, []), "id", "text", none, "given_name", "k").count() == 0
    with pytest.raises(ValueError):
        pii.replace_pii(frame(spark, []), "id", "text", none, "given_name", "")


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "commentarium")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "commentarium.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
