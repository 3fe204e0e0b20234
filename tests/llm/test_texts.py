import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import leaks, personal, tokens

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(open(tokens.default_vocabulary(), "rb").read())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert b"".join(encoder.token[i] for i in encoder.encode(text)) == text.encode()


def test_long_pretokens_and_special_strings(encoder, library):
    rng = random.Random(1)
    for text in ("a" * 30_000, "ab" * 9_999, "".join(rng.choice("abcde") for _ in range(40_000)), "中文字" * 5_000, "<|endoftext|> x", " \n\n\t  x  "):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_ids_of_null_empty_and_repeated_texts(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "ab", 9), (3, "ab", 9)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in tokens.token_ids(df).collect()) == [(1, []), (2, []), (3, [397]), (3, [397])]
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_rank_queue_gives_ranks_in_order():
    queue, rng = tokens.RankQueue(50_256), random.Random(2)
    pushed = [(rng.randrange(50_256), i) for i in range(500)]
    for rank, place in pushed:
        queue.push(rank, place)
    popped = []
    while (step := queue.pop()) is not None:
        popped += [(step[0], p) for p in step[1]]
    assert popped == sorted(pushed)


def brute_leaks(documents, items, window):
    found = set()
    for doc, text in documents:
        said = leaks.words(text)
        grams = {tuple(said[i : i + window]) for i in range(len(said) - window + 1)}
        for item, other in items:
            other = leaks.words(other)
            if any(tuple(other[i : i + window]) in grams for i in range(len(other) - window + 1)):
                found.add((item, doc))
    return found


def test_leaks_equal_brute_force_on_the_tables(spark):
    docs, items = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/benchmark.parquet")
    want = brute_leaks(zip(docs.doc_id, docs.text), list(zip(items.item_id, items.text)), 12)
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    assert want and {(r.item_id, r.doc_id) for r in leaks.leaked(read("documents"), read("benchmark")).collect()} == want


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_brute_force_on_a_small_alphabet(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items, docs = [(i, text(rng.randrange(12))) for i in range(8)], [(i, text(rng.randrange(60))) for i in range(30)]
    patterns = leaks.Patterns([(i, leaks.words(t)) for i, t in items], 5)
    assert {(i, d) for d, t in docs for i in patterns.search(leaks.words(t))} == brute_leaks(docs, items, 5)


def test_leak_edges(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "x " + passage.upper().replace(" ", "_ ") + " y", "a"), (2, None, "a"), (3, "", "a"), (4, passage[:-4], "a"), (1, passage, "a"), (5, "ｗ０ " + passage[3:].replace("w5", "w​5"), "a"), (None, passage, "a")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, passage), (11, "w0 w1"), (12, None), (13, ""), (14, "q " + passage)], "item_id bigint, text string")
    want = {(10, 1), (14, 1), (10, 5), (14, 5)}
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "ITEMS_PER_BLOCK", 2)  # blocks of items give the same
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == want
    assert leaks.leaked(docs, items.limit(0)).count() == 0 and leaks.leaked(docs.limit(0), items).count() == 0


GIVEN, FAMILY = ["Orla", "Bram", "Yevka", "Rafi", "Rose"], ["Quillmere", "O'Thrane", "Vexley", "Meldrum-Oake"]
FRAMES = ["Annotated by {}.", "Patient name: {}", "Thanks to {} for the set.", "{} kept the slide.", "cc: {}", "We met {} and went on."]
PLAIN = ["The probe drifts at layer 3.", "The Vexley index stayed flat.", "Rose tinted crops were dropped.", "See run 202577-3214 for the same seed.", "Tray 4336-0575 held the slides.", "loss=0.1485 dead=0.997", "Use the img@2x.png asset."]
DETAILS = [("MRN: {}", "id_number", "00816507"), ("passport no {}", "id_number", "EY1622327"), ("Call {} if needed.", "phone", "+49 30 23125 079"), ("Phone: {}", "phone", "(907) 555-0173"), ("Contact: {}", "email", "rafi.vexley@example.org"), ("Send it to {}.", "email", "orla92 [at] mail [dot] example"), ("Deliver to {} before noon.", "address", "Apt 39, 332 Fennel Road, Felbury"), ("Adresse : {}.", "address", "90, avenue des Tilleuls, 94721 Felbury"), ("Anschrift: {}", "address", "Hofgrabenstr. 25, 23965 Ostrand")]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        lines, own = rng.choices(PLAIN, k=3), set()
        if rng.random() < 0.7:
            name = rng.choice([f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", f"{rng.choice(FAMILY)}, {rng.choice(GIVEN)}", f"{rng.choice('ABC')}. {rng.choice(FAMILY)}"])
            lines.append(rng.choice(FRAMES).format(name))
            own.add(("name", name))
        frame, kind, said = rng.choice(DETAILS)
        lines.append(frame.format(said))
        own.add((kind, said))
        rng.shuffle(lines)
        texts.append("\n".join(lines))
        truth.append(own)
    return texts, truth


def test_details_of_held_out_texts():
    texts, _ = corpus(1500, 1)
    hints = personal.prepare(texts, GIVEN[:4], FAMILY[:3])
    field = personal.train(texts, hints)
    held, truth = corpus(300, 2)
    found = [{(k, t[s:e]) for s, e, k in spans} for t, spans in zip(held, personal.mentions(held, hints, field))]
    right, said, meant = sum(len(f & t) for f, t in zip(found, truth)), sum(map(len, found)), sum(map(len, truth))
    assert right / said >= 0.95 and right / meant >= 0.9


def test_an_unlisted_name_in_a_third_of_the_texts_is_found():
    """Its two parts are always together, as those of a fixed phrase; a phrase that is no name stays."""
    texts, _ = corpus(1500, 1)
    rng = random.Random(4)
    texts = [t + "\n" + (rng.choice(FRAMES).format("Xavika Zorplund") if i % 3 == 0 else "The Great Pyrenees crops were kept.") for i, t in enumerate(texts)]
    hints = personal.prepare(texts, GIVEN[:4], FAMILY[:3])
    field = personal.train(texts, hints)
    said = [{t[s:e] for s, e, k in spans if k == "name"} for t, spans in zip(texts, personal.mentions(texts, hints, field))]
    third = said[::3]
    assert sum("Xavika Zorplund" in x for x in third) >= 0.95 * len(third)
    assert sum("Great Pyrenees" in x for x in said) == 0


def test_copies_of_a_text_count_once():
    texts = corpus(300, 6)[0] + ["Signed: Xavika Zorplund for all."] * 200
    assert not {"xavika", "zorplund"} & personal.prepare(texts, GIVEN, FAMILY).common


def test_ordinary_words_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(personal, "FIT_DOCUMENTS", 50)
    texts = corpus(600, 7)[0] + ["Nothing"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hints = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY], "name string, kind string")
    got = personal.Detector(docs, hints).hints
    want = personal.prepare(texts, GIVEN, FAMILY)
    assert len(want.common) > 30 and (got.common, got.fixed) == (want.common, want.fixed)


def test_names_of_few_votes_stay_in_a_large_lexicon(spark, monkeypatch):
    monkeypatch.setattr(personal, "train", lambda texts, hints: None)
    names = ["Zor" + a + b for a in "abcd" for b in "klmn"]
    texts = [f"Annotated by Orla {n}. Item {i}" for i in range(3) for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known, _ = personal.Detector(docs, spark.createDataFrame([("Orla", "given")], "name string, kind string")).model.value
    assert all(known.of(n.lower()) == 2 for n in names)


def test_names_joined_to_their_texts_give_the_same(spark, monkeypatch, tmp_path):
    """More names than are sent to every task: each text gets those it holds."""
    texts = corpus(400, 8)[0] + [None, "", "orla zorbik was here"] + [f"Annotated by Orla Zorbik. Item {i}" for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "Orla Zorbik")], "doc_id bigint, text string")
    hints = spark.createDataFrame([("Orla", "given")], "name string, kind string")
    one = personal.Detector(docs, hints)
    monkeypatch.setattr(personal, "NAMES_SENT", 0)
    other = personal.Detector(docs, hints)
    one.save(str(tmp_path / "one"))
    monkeypatch.setattr(personal, "NAMES_SENT", 100_000)
    again = personal.Detector(docs, saved=str(tmp_path / "one"))
    assert sorted(map(tuple, again.found().collect())) == sorted(map(tuple, one.found().collect()))
    monkeypatch.setattr(personal, "NAMES_SENT", 0)
    assert one.sent and not other.sent and one.names.count() == other.names.count() > 0
    assert sorted(map(tuple, one.found().collect())) == sorted(map(tuple, other.found().collect()))
    assert sorted(map(tuple, one.redacted().collect()), key=str) == sorted(map(tuple, other.redacted().collect()), key=str)


def test_plain_lines_are_cut_as_by_the_whole_pattern():
    """Lines without addresses are cut by another pattern: the units are the same."""
    lines = ["J. Smith's don't-ask AB123456 and 12-04-1999", "x_y foo-12345678 (030) 23125 079", "Ångström ½ 3.14 e\u0301t\u00e9 J.K. 7", "A.\u00a0B", "tab\tEnd: 00816507_"]
    text = "\n".join(lines)
    u = personal.Units(text + "\n12 High Street, Leeds\n" + text)
    whole = [(m.group(), m.start(), m.lastgroup) for m in personal.UNITS[True, True].finditer(u.text)]
    assert [(s, a) for s, a, _ in whole] == list(zip(u.said, u.start))
    assert [k for *_, k in whole if k in ("email", "address", "word", "mark", "break")] == [k for k in u.kind if k not in ("number", "digits")]


def test_skip_edges_carry_a_label_to_a_repeated_unit():
    import numpy as np

    chains = personal.Chains([1, 1])
    emission = np.zeros((2, len(personal.LABELS)))
    emission[0, 5], emission[1, 0] = 4.0, 0.5
    none = (np.zeros(0, int), np.zeros(0, int))
    transition = np.zeros((len(personal.LABELS),) * 2)
    assert list(personal.infer(chains, emission, transition, none)) == [5, 0]
    assert list(personal.infer(chains, emission, transition, (np.array([0]), np.array([1])))) == [5, 5]


def test_the_weight_of_skip_edges_is_what_labels_best():
    """A name shown clearly once and unclearly later needs the edge; one that is not a name everywhere is hurt by it."""
    import numpy as np

    clear, vague = np.zeros(len(personal.LABELS)), np.zeros(len(personal.LABELS))

    class Field:
        transition = np.zeros((len(personal.LABELS),) * 2)
        index = {}

        def __init__(self, rows):
            self.rows = rows

        def emission(self, rows):
            return np.array(self.rows)

    hints = personal.Hints([], ["Zorplund"], {"was", "in", "then", "came"})
    u = personal.Units("Zorplund was in. Zorplund")
    clear[1], vague[0] = 4.0, 0.6
    runs = [range(0, 1), range(4, 5)]
    assert personal.skip_weight([(u, runs, {0: 1, 4: 1})], hints, Field([clear, vague]), random.Random(1)) > 0
    assert personal.skip_weight([(u, runs, {0: 1, 4: 0})], hints, Field([clear, vague]), random.Random(1)) < 1.0
    assert personal.skip_weight([], hints, Field([]), random.Random(1)) == personal.SKIP_WEIGHTS[0]


def test_similar_forms_are_joined():
    assert personal.alike("müller") == personal.alike("muller") and personal.alike("plain") == "plain"


def test_evidence_reaches_every_repeat(monkeypatch):
    """All mentions of a text are joined to the first, those in small letters too."""
    taken = {}
    monkeypatch.setattr(personal, "infer", lambda chains, emission, transition, skips, weight: taken.setdefault("skips", skips) and [0] * len(emission))
    field = personal.fit_field([], {})
    personal.mentions(["Zorplund was in. " + "The probe drifts on and on. Zorplund left. " * 6 + "Then zorplund again."], personal.Hints([], ["Zorplund"], {"the", "then", "probe", "drifts", "on", "and", "left", "was", "in", "again"}), field)
    left, right = taken["skips"]
    assert len(right) == 7 and set(left) == {left[0]}


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    size = len(personal.LABELS)
    emission, transition = rng.normal(size=(3, size)), rng.normal(size=(size, size))
    score = {p: sum(emission[i, y] for i, y in enumerate(p)) + transition[p[0], p[1]] + transition[p[1], p[2]] for p in itertools.product(range(size), repeat=3)}
    total = np.log(sum(np.exp(v) for v in score.values()))
    node, _, log_total = personal.Chains([3]).beliefs(emission, transition)
    assert log_total == pytest.approx(total)
    want = np.log(sum(np.exp(v) for p, v in score.items() if p[1] == 2)) - total
    assert node[1, 2] == pytest.approx(want)
    assert tuple(personal.Chains([3]).best(emission, transition)) == max(score, key=score.get)


def test_redaction_leaves_the_rest():
    assert personal.redact("Call +1 2 now", [(5, 9, "phone")]) == "Call [PHONE] now"
    assert personal.redact("", []) == ""


def test_redaction_keeps_every_row(spark):
    docs = [(1, None), (2, ""), (None, "MRN: 00816507"), (None, None)] + [(100 + i, t) for i, t in enumerate(corpus(300, 3)[0])]
    hints = spark.createDataFrame([("Orla", "given")], "name string, kind string")
    done = personal.Detector(spark.createDataFrame(docs, "doc_id bigint, text string"), hints).redacted().filter("doc_id IS NULL OR doc_id < 100").collect()
    assert sorted(map(tuple, done), key=str) == sorted([(1, None), (2, ""), (None, "MRN: [ID_NUMBER]"), (None, None)], key=str)


def test_details_of_odd_tables(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "   ", "a"), (4, "MRN: 00816507 and MRN: 00816507\n" + "x " * 20_000 + "\nPhone: +49 30 23125 079", "a"), (4, "MRN: 00816507", "a"), (None, "MRN: 00816507", "a")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, mention string")
    hints = spark.createDataFrame([(1, "Orla", "given"), (2, None, "family")], "name_id bigint, name string, kind string")
    more = spark.createDataFrame([(100 + i, t, "a") for i, t in enumerate(corpus(400, 3)[0])], docs.schema)
    found = personal.Detector(docs.unionByName(more), hints).found().filter("doc_id < 100").collect()
    assert {tuple(r) for r in found} == {(4, "id_number", "00816507"), (4, "phone", "+49 30 23125 079")}
    assert personal.Detector(docs.limit(0), hints.limit(0)).found().count() == 0
