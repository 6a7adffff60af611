"""Cut texts, packing, mixing and quality."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.llm import cut, mixing, packing, quality, tokens
from loomsearch.llm.common import materialise

NOUNS = ["council", "bridge", "market", "river", "hospital", "company", "station", "teacher"]


def sentence(rng):
    return rng.choice(
        [
            f"The {rng.choice(NOUNS)} of {rng.choice(['Ham', 'Dor', 'Vin'])} was closed on Monday.",
            f"They said that the {rng.choice(NOUNS)} would open the {rng.choice(NOUNS)} again.",
            f"Neither the {rng.choice(NOUNS)} nor the {rng.choice(NOUNS)} has said why.",
        ]
    )


def test_cut_texts(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(600):
        text = " ".join(sentence(rng) for _ in range(8))
        if i % 50 == 1:
            text = text[: rng.randrange(100, len(text))].rstrip(". ") + rng.choice(["", " ", "…", " [+20 chars]", " &quo"])
            if not text.endswith(tuple("why again Monday".split())):
                want.add(i)
        elif i % 10 == 2:
            text += "\nPhotograph: Ann Dor/Vin Rail"
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, " \n ")]
    flags = {r.doc_id: r.cut for r in cut.cut_texts(materialise(spark.createDataFrame(rows, "doc_id long, text string"), "t")).collect()}
    assert {i for i, f in flags.items() if f} >= want and not flags.keys() & {900, 901, 902}
    assert not [i for i, f in flags.items() if f and i % 50 != 1]
    assert cut.cut_texts(materialise(spark.createDataFrame([], "doc_id long, text string"), "t")).count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sentence(rng) for _ in range(8))) for i in range(300)]
    cut_off = " ".join(sentence(rng) for _ in range(6)) + " They said that the bridge would open the"
    rows += [(1000 + i, cut_off + " " * (i % 2)) for i in range(150)]
    flags = {r.doc_id: r.cut for r in cut.cut_texts(materialise(spark.createDataFrame(rows, "doc_id long, text string"), "t")).collect()}
    assert {i for i, f in flags.items() if f} == set(range(1000, 1150)) and len(flags) == 450


def test_half_words_that_many_texts_end_in(spark):
    # at a large scale the same half word ends many texts, and stands nowhere else
    rng = random.Random(3)
    report = lambda i, k: " ".join(f"They said that the {rng.choice(['hospital', 'river', 'Station'])} would open after {i * 97 + j} days." for j in range(k))
    rows = [(i, report(i, 50)) for i in range(600)]
    for n, end in enumerate(["hosp", "riv", "Stat", "hospital", "river", "Station"]):
        rows += [(1000 + 100 * n + i, report(1000 + 100 * n + i, 5) + f" They said that the {end}") for i in range(40 if n < 3 else 6)]
    rows += [(2000 + i, report(2000 + i, 5) + "\nPhotograph: Ann Dor/Vin Rail") for i in range(60)]
    rows += [(3000 + i, report(3000 + i, 5) + " More than 1,") for i in range(40)]
    flags = {r.doc_id: r.cut for r in cut.cut_texts(materialise(spark.createDataFrame(rows, "doc_id long, text string"), "t")).collect()}
    assert {i for i, f in flags.items() if f} == {i for i, _ in rows if 1000 <= i < 2000 or i >= 3000}


def test_cut_report(spark):
    flags = spark.createDataFrame([(1, True), (2, False), (3, False)], "doc_id long, cut boolean")
    articles = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, None, True), (4, "a", True)], "doc_id long, source string, cut boolean")
    assert {r.source: (r.n_articles, r.n_cut, r.cut_share) for r in cut.cut_report(flags, articles).collect()} == {"a": (2, 1, 0.5), "": (1, 0, 0.0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_pack_keeps_everything_within_capacity(sizes):
    parts = packing.pack(sizes, 100)
    assert sorted(i for part in parts for i in part) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in part) <= 100 for part in parts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(0, 2))
def test_pack_needs_no_more_than_first_fit_decreasing(sizes, kind):
    sizes = [s if kind == 0 else 1 + s * 2 // 3 if kind == 1 else 20 + s * 6 // 10 for s in sizes]
    n = len(packing.pack(sizes, 100))
    assert packing.lower_bound(sizes, 100) <= n <= len(packing.first_fit_decreasing(sizes, 100))


def test_pack_is_tight():
    rng = random.Random(5)
    for low, high, capacity in ((1, 512, 512), (400, 1400, 2048), (20, 900, 2048), (50, 400, 8192)):
        sizes = [rng.randrange(low, high + 1) for _ in range(400)]
        assert len(packing.pack(sizes, capacity)) <= packing.lower_bound(sizes, capacity) * 1.03 + 1


def test_packed_texts_takes_apart_what_overfills_a_window():
    rows = packing.packed_texts([1005, 200, 100, 99, 1], 100)
    assert {r[0] for r in rows if r[2] > 1} == {0, 1} and sum(r[3] for r in rows) == 1405 and len({r[4] for r in rows}) == 15


def test_differencing_balances():
    sums = [sum([8, 7, 6, 5, 4][i] for i in part) for part in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]


def test_packed(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 60)) for i in range(400)] + [(1000, 1005), (1001, 200), (1002, 100)]
    sizes = materialise(spark.createDataFrame(rows, "doc_id long, tokens long"), "s")
    out = packing.packed(sizes, 100, group_items=150)
    got = out.collect()
    windows = {}
    for r in got:
        windows[r.group_no, r.window_no] = windows.get((r.group_no, r.window_no), 0) + r.tokens
    assert max(windows.values()) <= 100 and sum(windows.values()) == sum(t for _, t in rows)
    assert sorted(r.doc_id for r in packing.split_texts(out).collect()) == [1000, 1001]
    assert packing.fill_report(out, 100).first().fill > 0.9
    empty = packing.packed(materialise(spark.createDataFrame([], "doc_id long, tokens long"), "e"), 100)
    assert empty.count() == 0 and packing.fill_report(empty, 100).first().fill is None


def test_token_counts(spark):
    rows = [(1, "Hello  world's 12 end\n"), (2, None), (3, ""), (4, "a" * 100_000)]
    got = {r.doc_id: r.tokens for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == got[3] == 0 and 5 <= got[1] <= 9 and got[4] > 1000


def test_flow_is_cheapest():
    # two patterns, two targets: the shared pattern goes where the other can't
    arcs = [(0, 2, 10, 0), (0, 2, 10, 1), (0, 3, 10, 0), (2, 4, 20, 0), (3, 4, 10, 0), (3, 5, 10, 0), (4, 1, 20, 0), (5, 1, 10, 0)]
    flow = mixing.min_cost_flow(6, arcs, 0, 1)
    assert flow == [10, 10, 10, 20, 0, 10, 20, 10]


def test_mixing(spark):
    rows = [(i, "a" if i < 300 else "b" if i < 330 else "c", 10 + i % 7, i) for i in range(400)] + [(500, "a", 11, 1), (501, None, 5, 77), (502, "b", 0, 78)]
    documents = materialise(spark.createDataFrame(rows, "doc_id long, source string, tokens long, text_key long"), "d")
    targets = mixing.clean_targets(spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3), (None, 0.1, 1), ("z", 0.01, 2)], "source string, target_share double, max_repeats int"))
    total = sum(r[2] for r in rows)
    texts = materialise(mixing.texts_by_pattern(documents, targets), "t")
    planned = mixing.plan_frame(texts, targets, total)
    assert sorted(r.source for r in mixing.short_sources(planned).collect()) == ["b", "z"]
    picked = mixing.selection(texts, planned).collect()
    limits = {"a": 2, "b": 2, "c": 3}
    assert all(1 <= r.uses <= limits[r.source] for r in picked) and not [r for r in picked if r.doc_id == 500]
    shares = {r.source: r.share for r in mixing.reached_shares(mixing.selection(texts, planned), targets, total).collect()}
    assert abs(shares["a"] - 0.5) < 0.01 and abs(shares["c"] - 0.2) < 0.01 and shares["b"] < 0.3 and shares["z"] == 0
    assert picked == mixing.selection(texts, planned).collect()
    none = materialise(mixing.texts_by_pattern(documents.limit(0), targets), "n")
    assert mixing.selection(none, mixing.plan_frame(none, targets, 0)).count() == 0


def test_mixing_in_rows_of_buckets(spark, monkeypatch):
    # many buckets: the texts picked follow the flow to the token, as in one line
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = [(i, "a" if i % 3 else "b", 5 + i % 11, str(i)) for i in range(600)]
    documents = materialise(spark.createDataFrame(rows, "doc_id long, source string, tokens long, text_key string"), "d")
    targets = mixing.clean_targets(spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 3)], "source string, target_share double, max_repeats int"))
    total = sum(r[2] for r in rows)
    texts = materialise(mixing.texts_by_pattern(documents, targets), "t")
    planned = mixing.plan_frame(texts, targets, total)
    shares = {r.source: r.share for r in mixing.reached_shares(mixing.selection(texts, planned), targets, total).collect()}
    assert abs(shares["a"] - 0.4) < 0.01 and abs(shares["b"] - 0.6) < 0.01
    assert all(r.uses <= (2 if r.source == "a" else 3) for r in mixing.selection(texts, planned).collect())


def test_flow_equals_brute_force():
    # all integer flows of small networks are tried
    rng = random.Random(3)
    for _ in range(25):
        arcs = [(0, 2, rng.randrange(3), 0), (0, 2, rng.randrange(3), 1), (0, 3, rng.randrange(3), rng.randrange(3)), (2, 4, 2, 0), (2, 5, rng.randrange(3), 1), (3, 5, 2, 0), (4, 1, rng.randrange(3), 0), (5, 1, rng.randrange(4), 0)]
        best = None
        for flow in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
            net = [0] * 6
            for (a, b, _, _), f in zip(arcs, flow, strict=True):
                net[a] -= f
                net[b] += f
            if all(net[n] == 0 for n in range(2, 6)):
                value = (net[1], -sum(f * p for (_, _, _, p), f in zip(arcs, flow, strict=True)))
                best = value if best is None else max(best, value)
        got = mixing.min_cost_flow(6, arcs, 0, 1)
        assert (got[6] + got[7], -sum(f * p for (_, _, _, p), f in zip(arcs, got, strict=True))) == best


def test_mixing_shared_texts(spark):
    rows = [(1, "a", 10, 1), (2, "b", 10, 1), (3, "b", 10, 3)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, tokens long, text_key long")
    targets = mixing.clean_targets(spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int"))
    texts = materialise(mixing.texts_by_pattern(documents, targets), "t")
    picked = {(r.doc_id, r.source): r.uses for r in mixing.selection(texts, mixing.plan_frame(texts, targets, 20)).collect()}
    assert picked == {(1, "a"): 1, (3, "b"): 1}


@pytest.mark.parametrize(
    ("body", "kind"),
    [
        ("The council said on Monday that it would open the bridge again.", "prose"),
        ("they did not open the bridge because the votes had been counted and the price of it was too high for them it was said that the rest would follow by the end of the year", "prose"),
        ("“Did they open it?” she said.\n“No, they did not,” he said. “It is too late for that now.”", "prose"),
        ("The plan was dropped in the spring, and they said why.\n- new roads\n- old ships\nThe rest of it is still to be done by the end of the year.", "prose"),
        ("- red ship\n- blue road\n- Harbour View\n- two banks", "list"),
        ("Name | Score | Rank\nHam | 12.5 | 3\nDor | - | 4\nVin | +3 | 18%", "table"),
        ("#~*!- ►★ =_?.! ▒▒ #!~\n▒=*- ?!", "junk"),
        ("Buy now cheap | " * 30, "junk"),
        ("T h e c o u n c i l s a i d i t w o u l d o p e n .", "junk"),
        ("", "empty"),
    ],
)
def test_kinds(body, kind):
    assert quality.kind_of(quality.figures("A headline\n" + body)) == kind


def test_quality(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "only a headline", "x"), (4, "h\n" + "It was the end of the day, and they said so. " * 20_000, "x"), (5, "h\n\n \n", "x")]
    got = {r.doc_id: r.kind for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), "empty")
    # one sentence said twenty thousand times is repetition, not prose
    assert got[4] == "junk"
    figures = quality.figures("h\none line\none line\n\nother")
    assert figures["n_lines"] == 3 and 0 < figures["duplicate_line_share"] < 0.5


@pytest.mark.parametrize(("n_words", "share"), [(3, 1.0), (6, 1.0), (26, 13 / 26), (30, 13 / 30)])
def test_dominant_share_of_repeated_blocks(n_words, share):
    # a block of different words of one length, said again and again on one line: 3, 6 and 13 words cover more of it than 2, 4 or 9
    words = [a + b for a in "abcdef" for b in "ghijkl"][:n_words]
    assert quality._dominant_share(words * 4) == pytest.approx(share)
    if n_words > 6:
        text = "A headline\n" + " ".join(("the of and to in was for on with as by it they " + " ".join(words[13:])).split() * 4) + "."
        assert quality.figures(text)["dominant_ngram_share"] >= 0.35 and quality.kind_of(quality.figures(text)) == "junk"


@pytest.mark.parametrize(
    "body",
    [
        "il ponte era chiuso da anni\nma il consiglio ha detto che non lo apre\nperché la città non ha i soldi\ne la gente del quartiere è stanca di aspettare",
        "a ponte foi fechada em maio\nmas o conselho não disse quando\nporque a cidade não tem dinheiro para isso\ne os vizinhos já não querem esperar mais",
        "most był zamknięty od lat\nale rada nie chce o tym mówić\nbo nie ma na to pieniędzy\ni ludzie są już zmęczeni czekaniem",
        "bron har varit stängd i flera år\nmen rådet vill inte prata om den\ndå det inte finns pengar till det\noch folk är trötta på att vänta",
        "мост был закрыт много лет\nно совет не хочет о нём говорить\nпотому что на это нет денег\nи люди уже устали ждать",
        "köprü yıllardır kapalı ve bu böyle\nama meclis bu konuda bir şey demiyor\nçünkü bunun için para yok\nve daha çok beklemek gerek gibi",
        "橋は何年も前から閉まっている\nしかし町の議会はその話をしない\nお金がないからだと人々は言う\n待つことに疲れた人も多い",
        "这座桥已经关闭了很多年\n但是市议会不想谈这件事\n因为他们没有钱来修\n人们等得很累了",
        "daraja lilifungwa kwa miaka mingi na baraza la mji halitaki kusema lolote kwa sababu hakuna fedha za kulijenga tena na watu wa mtaa huo wamechoka",
        "de brug is al jaren dicht\nmaar de raad wil er niet over praten\nomdat er geen geld voor is\nen de mensen zijn het wachten nu wel zat",
    ],
)
def test_prose_of_more_languages(body):
    # short lines without end marks: only common words hold them together
    assert quality.kind_of(quality.figures("A headline\n" + body)) == "prose"


def test_common_words_are_whole():
    assert {"into", "through", "werden", "sein", "sans", "entre", "cuando", "anche", "também", "het"} <= quality.COMMON_WORDS


@pytest.mark.parametrize(("body", "kind"), [("東京\n大阪\n名古屋\n札幌\n福岡", "list"), ("market school retailer monthly tower visa student courts planned budget " * 2 + "harbour film ferry", "junk")])
def test_no_prose(body, kind):
    assert quality.kind_of(quality.figures("A headline\n" + body)) in (kind, "list", "junk")


def test_dominant_share_of_a_long_gram_said_less_often():
    # "a b" is said three times, but the long one covers more
    words = "a b x a b y a b longphrase1 word1 z longphrase1 word1".split()
    assert quality._dominant_share(words) == pytest.approx(32 / sum(map(len, words)))


def test_agreement(spark):
    documents = spark.createDataFrame([(1, "h\nIt was the end of the day, and they said so."), (2, "h\n- red ship\n- blue road\n- two banks"), (3, "h\n#~*!- ►★ =_?.!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "prose"), (1, "prose"), (2, "list"), (3, None), (9, "junk")], "doc_id long, label string")
    assert {(r.label, r.kind, r.held_out, r.n) for r in quality.agreement(quality.quality(documents), labels).collect()} == {("prose", "prose", True, 1), ("list", "list", False, 1)}
