"""Places where an operator once did less than its whole job."""

import random

import numpy as np

from ledgerlens.llm import latent_leaks, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_every_verbatim_item_is_found_with_many_more_passages_than_dimensions(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices(LETTERS, k=r.randint(2, 8))) for _ in range(3000)]
    weights = [1 / (k + 5) for k in range(len(vocabulary))]
    said = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    items = [(i, said(r.randint(15, 60))) for i in range(400)]
    docs = [(i, f"{said(r.randint(0, 90))} {t} {said(r.randint(0, 90))}") for i, t in items] + [(1000 + i, said(120)) for i in range(200)]
    got = latent_leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.where("coverage = 1").collect()} == {(i, i) for i, _ in items}


def test_leaks_do_not_depend_on_slices_or_blocks(spark, monkeypatch):
    r = random.Random(18)
    vocabulary = ["".join(r.choices(LETTERS, k=r.randint(2, 8))) for _ in range(1500)]
    said = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, said(r.randint(20, 60))) for i in range(90)]
    changed = lambda t, k: " ".join(r.choice(vocabulary) if j % k == k - 1 else w for j, w in enumerate(t.split()))
    docs = [(i, f"{said(20)} {changed(t, 6) if i % 2 else t} {said(30)}") for i, t in items] + [(500 + i, said(100)) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **how: {(x.doc_id, x.item_id, x.shared) for x in latent_leaks.find_leaks(d, b, **how).collect()}
    whole = found()
    assert {x[:2] for x in whole} == {(i, i) for i, _ in items}
    assert found(slice_items=20) == whole and found(slice_chars=4_000) == whole
    monkeypatch.setattr(latent_leaks, "PASSAGES", 7)
    assert found() == whole


def test_a_paraphrase_is_found_by_its_answer(spark):
    r = random.Random(19)
    vocabulary = ["".join(r.choices(LETTERS, k=r.randint(3, 8))) for _ in range(800)]
    question, answer = r.sample(vocabulary, 26), r.sample(vocabulary, 6)
    item = " ".join(question) + ". " + " ".join(answer) + "."
    half = [w if j % 2 else r.choice(vocabulary) for j, w in enumerate(question)]  # half of the question's words are others
    docs = [(1, " ".join(half) + ". " + " ".join(answer)), (2, " ".join(half) + ". " + " ".join(r.sample(vocabulary, 6)))] + [(10 + i, " ".join(r.choices(vocabulary, k=60))) for i in range(200)]
    got = latent_leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.answer) for x in got] == [(1, True)] and got[0].coverage < 0.6


def channel(*more):
    counts = np.zeros((27, 27, 27))
    ordinary = "such a loser you are a moron and an idiot is not very stupid he said that they were all here with the other people of this house " * 20
    text = toxicity._codes(" " + ordinary + " ")
    np.add.at(counts, (text[:-2], text[1:-1], text[2:]), 1)
    return toxicity.Channel(counts, ["idiot", "moron", "stupid", "loser", *more])


def test_spaced_letters_have_word_boundaries_and_no_last_letter():
    ch = channel()
    for said, meant in {"such a l o s e r here": {"loser"}, "you are a m o r o n": {"moron"}, "s t u p i d i d i o t": {"stupid", "idiot"}}.items():
        assert meant <= set(toxicity.spaced(said.split(), lambda _: ch)), said
    filler = "t h a t t h e y w e r e a l l h e r e " * 20
    assert {"moron"} <= set(toxicity.spaced((filler + "m o r o n").split(), lambda _: ch))


def test_all_classes_of_obfuscated_tokens_are_read():
    ch = channel()
    for seen, meant in {"you-l0s3r": "loser", "you_l0s3r": "loser", "iidiioott": "idiot", "ídi0t": "idiot", "you-are-a-l0s3r-and-such-a-m0r0n-they-said-that": "moron", "l" + "o" * 60 + "ser": "loser", "you-s.t.u.p.i.d": "stupid"}.items():
        assert meant in toxicity.plain_words(seen, ch), seen


def test_accents_short_runs_and_broken_words_are_read():
    ch = channel("ass")
    number = {w: i for i, w in enumerate(["idiot", "moron", "^moro", "stupid", "loser", "ass"])}
    read = toxicity.Reader(ch, number)
    for said, meant in {"mörön": "moron", "idiöt here": "idiot", "m0rön": "moron", "a s s": "ass", "mo ron": "moron", "m o ro n": "moron", "mor on": "moron", "you are a sTu pid one": "stupid", "lo ser": "loser", "mör ons": "^moro"}.items():
        assert number[meant] in read.words(said), said
    for said in ("the house of other people", "he said that they were all here", "as so", "lo and see"):
        assert not read.words(said), said


def test_repetitions_are_read_alike_in_words_of_any_length():
    ch = channel()
    for n in (3, 4, 12, 36, 60):
        assert "loser" in toxicity.plain_words("l" + "o" * n + "ser", ch), n
        assert "loser" in toxicity.plain_words("you-" + "l" + "0" * n + "s3r", ch), n


def test_tokens_left_undecoded_would_have_given_nothing():
    ch, lexicon = channel(), ["idiot", "moron", "^stup", "loser", "idiöt"]
    number = {w: i for i, w in enumerate(lexicon)}
    r = random.Random(5)
    tokens = ["m0r0n", "1d10t", "ídi0t", "s.t.u.p.i.d", "l-o-s-e-r", "m*r*n", "iidiioott"]
    tokens += ["".join(r.choices("idotmrnslep0134!|*.-@$", k=r.randint(1, 14))) for _ in range(1500)]
    read = toxicity.Reader(ch, number)
    for t in tokens:
        whole = {number[x] for x in toxicity.with_stems(toxicity.plain_words(t, ch)) if x in number}
        assert read.words(t) == whole, t
    assert sum(read._channel(t) is None for t in tokens) > 300
