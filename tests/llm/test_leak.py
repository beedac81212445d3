import random

import pytest

from penumbra.llm import leak

R = random.Random(7)
VOCAB = ["".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(600)] + ["été", "naïve", "größe", "señal", "wasn’t"]


def passage(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, " ".join(passage(70, i))) for i in range(1, 9)] + [(20, None), (21, ""), (22, "too short to leak")]
P = {i: passage(70, i) for i in range(1, 9)}
FILL = " ".join(passage(90, 100))


def edited(words, every):
    return [("zzz" if k % 2 else "") if i % every == every // 2 else w for k, (i, w) in enumerate(enumerate(words))]


CASES = {
    "whole": (" ".join(P[1]), {1}),
    "in a page": (FILL + "\n" + " ".join(P[2][10:45]) + "\n" + FILL, {2}),
    "upper, punctuation, lines": (FILL + "\n* ".join([""] + [w.upper() + "," for w in P[3]]), {3}),
    "entities and no marks": (" ".join(P[4]).replace("é", "&eacute;").replace("ö", "o").replace("’", "&#8217;").replace("ñ", "&ntilde;"), {4}),
    "wrong charset": (FILL.encode().decode("latin-1") + " " + " ".join(P[5]).encode("utf-8").decode("cp1252", "replace"), {5}),
    "invisible characters": (" ".join(w[:2] + "​­" + w[2:] for w in P[6]), {6}),
    "one word in twelve edited": (FILL + " " + " ".join(edited(P[7], 12)), {7}),
    "two items": (" ".join(P[1][:40]) + " " + FILL + " " + " ".join(P[8][30:]), {1, 8}),
    "twenty words only": (FILL + " " + " ".join(P[1][:20]) + " " + FILL, set()),
    "one word in four edited": (" ".join(edited(P[2], 4)), set()),
    "other order": (" ".join(random.Random(1).sample(P[3], 70)), set()),
    "blocks of six in another order": (" ".join(" ".join(P[4][k : k + 6]) for k in random.Random(2).sample(range(0, 66, 6), 11)), set()),
    "empty": ("", set()),
    "null": (None, set()),
    "very long": ((FILL + " ") * 300 + " ".join(P[5][:33]) + " " + (FILL + " ") * 300, {5}),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES.values())], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id bigint, text string")
    return [tuple(r) for r in leak.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()]


@pytest.mark.parametrize("name", list(CASES))
def test_case(found, name):
    at = list(CASES).index(name)
    assert {i for d, i in found if d == at} == CASES[name][1]


def test_each_pair_once(found):
    assert len(found) == len(set(found))


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(P[1])), (2, " ".join(P[8]))], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(leak, "BLOCK_WORDS", 200)
    run = lambda d, i: {tuple(r) for r in leak.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert run(docs, items) == {(1, 1), (2, 8)}
    assert run(docs.limit(0), items) == set() and run(docs, items.limit(0)) == set()


def test_passages_by_brute_force():
    """The prefix filter loses no passage that an alignment of whole texts finds."""
    block = leak.Block([(i, t) for i, t in ITEMS if t])
    r = random.Random(3)
    block.order_by_rarity(__import__("numpy").array([r.randint(0, 50) for _ in block.code]))
    for trial in range(60):
        i = r.randint(1, 8)
        n, at = r.randint(24, 60), r.randint(0, 8)
        w = P[i][at : at + n]
        for _ in range(r.randint(0, max(1, n // 9))):
            w[r.randrange(len(w))] = r.choice(["qqq", ""])
        ids = block.read(FILL + " " + " ".join(w) + " " + FILL)
        best = leak.best_passage(block.items[block.keys.index(i)], ids)
        assert (block.keys.index(i) in block.found(ids)) == bool(best and best[0])


def test_edits_near_the_ends():
    """Passages of few words are found wherever their edits stand."""
    block = leak.Block([(i, t) for i, t in ITEMS if t])
    block.order_by_rarity(__import__("numpy").zeros(len(block.code)))
    r = random.Random(5)
    for n in [*range(28, 42), 50]:
        for trial in range(8):
            i, at = r.randint(1, 8), r.randint(0, 20)
            w = P[i][at : at + n]
            for k in [1, n - 2] if trial == 0 else r.sample(range(n), n // 10):
                w[k] = r.choice(["qqq", "", w[k] + " qqq"])
            assert block.keys.index(i) in block.found(block.read(FILL + " " + " ".join(w) + " " + FILL)), (n, trial)
    for n, edits in [(25, []), (30, [4, 11, 18, 25]), (39, [4, 11, 18, 25, 32])]:  # too short, or one edit too many
        w = P[1][20 : 20 + n]
        for k in edits:
            w[k] = "qqq"
        assert block.found(block.read("qqq " * 40 + " ".join(w) + " qqq" * 40)) == []


def test_a_passage_after_many_shorter_quotations():
    """Pieces that score above the passage and are too short do not hide it, however many they are."""
    long = passage(300, 50)
    block = leak.Block([(1, " ".join(long))])
    block.order_by_rarity(__import__("numpy").zeros(len(block.code)))
    pieces = [" ".join(long[k : k + 25]) for k in range(240, -1, -30)]
    w = long[265:293]
    w[9] = w[18] = "qqq"
    short = (" qqq" * 12 + " ").join(pieces)
    assert block.found(block.read(short)) == []
    assert block.found(block.read(short + " qqq" * 40 + " " + " ".join(w))) == [0]
