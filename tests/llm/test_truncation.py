import random

from penumbra.llm import truncation

R = random.Random(4)
TOPICS = ["harbour", "garden", "archive", "library", "ferry", "market"]
SCHEMA = "doc_id bigint, text string, source string, h string"


def sentence():
    a, b = R.sample(TOPICS, 2)
    return R.choice([f"The {a} near the {b} was opened for {R.randint(2, 900)} days and about {R.randint(2, 900)} visitors asked for it.", f"Nobody in Town{R.randint(1, 99)} had seen the {a} before the {b} closed.", f"“We kept the {a} beside the {b},” wrote Guild {R.randint(1, 99)}, “and the rest followed.”"])


def page(i, end="", cut=None):
    t = "Home > Shop\nPlain " + R.choice(TOPICS) + " report\n" + "\n".join(" ".join(sentence() for _ in range(4)) for _ in range(3))
    if cut:
        stop = R.randint(200, len(t) - 60)
        while not (t[stop - 3 : stop].isalpha() and t[stop - 3 : stop].islower() and "\n" not in t[stop - 40 : stop]):
            stop += 1
        return t[:stop].rstrip() + cut.strip("!")
    return t + end


WHOLE = ["", "\nAll rights reserved site 2024", "\nShare this page: Mail Print Feed", "\nText: Guild Morro", "\n12 comments", "\n(to be continued)", "\nRead more"]


def corpus():
    rows, cut = [], set()
    for i in range(900):
        if i % 9 == 0:
            rows.append((i, page(i, cut=R.choice(["!", "…", " [...]", "&nbs", "</p", "�"])), "cuts.example", "x"))
            cut.add(i)
        else:
            rows.append((i, page(i, R.choice(WHOLE)), "whole.example", None))
    return rows, cut


def test_cut_and_whole_pages(spark):
    rows, cut = corpus()
    none = [(1001, None, "s", ""), (1002, "", "s", ""), (1003, " \n\t ", None, ""), (1004, "Sorry, this page could not be found.", "s", ""), (1005, "…", "s", ""), (1006, "a\n- In May\n- The harbour near the", "s", "")]
    df = spark.createDataFrame(rows + none, SCHEMA)
    got = [r["doc_id"] for r in truncation.find_cut(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and not set(got) - cut
    assert len(set(got) & cut) >= 0.97 * len(cut)
    share = {r["source"]: r for r in truncation.cut_by_source(df, "doc_id", "text", "source").collect()}
    assert share["cuts.example"]["pages"] == 100 and share["cuts.example"]["share"] >= 0.97 and share["whole.example"]["cut"] == 0
    again = [r["doc_id"] for r in truncation.find_cut(df.unionByName(df.where("doc_id = 0")), "doc_id", "text").collect()]
    assert again.count(0) in (0, 2)


def test_very_long_and_empty(spark):
    rows, _ = corpus()
    rows = rows[:100] + [(5000, " ".join(sentence() for _ in range(20_000)) + " The harbour near the", "s", "")]
    got = {r["doc_id"] for r in truncation.find_cut(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert 5000 in got
    assert truncation.find_cut(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_copies_of_a_cut_page_count_once(spark, monkeypatch):
    rows, _ = corpus()
    # the words at the cut are rare: six whole pages have them inside a sentence
    rare = "Nobody in Town5 had mended the copper lantern beside the ferry before the market closed."
    rows = rows + [(2000 + i, page(i) + "\n" + rare, "whole.example", None) for i in range(6)] + [(2010, page(10) + "\n" + rare[:45].rstrip(), "cuts.example", "x")]
    found = lambda r: {x["doc_id"] for x in truncation.find_cut(spark.createDataFrame(r, SCHEMA), "doc_id", "text").collect()}
    alone = found(rows)
    assert 2010 in alone
    some = sorted(alone)[:20] + [2010]
    text = {i: t for i, t, *_ in rows}
    # each page 30 times more: fetched again, and on mirrors whose menus differ and that put something else behind the cut
    again = [(10_000 * k + i, text[i] if k % 3 else f"Menu {k} | Maps {k * k}\n" + text[i].split("\n", 1)[1] + "…" * (k % 2), "m", "") for i in some for k in range(1, 31)]
    assert found(rows + again) == alone | {r[0] for r in again}
    monkeypatch.setattr(truncation, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(truncation, "HEAVY", 30)
    assert found(rows + again) == alone | {r[0] for r in again}
