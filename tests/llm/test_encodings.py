"""Wrong encodings: found in made cases, restored in a round trip, and left alone where shown on purpose."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.encodings import READ_AS, WRITTEN_IN, NgramModel, _scorer, a_word, byte_table, candidates, find_garbled, foreign, restore, spans_of
from tidemark.llm.made_cases import made_cases, misread

WORDS = {
    "de": "Die Wärmeleitfähigkeit übertrifft jede zulässige Störung außerhalb der Grenzschicht während der Abkühlung für größere Prüfkörper".split(),
    "fr": "La méthode itérée dépasse l’écart à l’équilibre où la fréquence mesurée contrôle le problème dégénéré résiduel".split(),
    "pl": "Główna część równania określa dokładność pomiaru łączną energię układu poza współczynnik tłumienia źródła".split(),
    "ru": "Средняя скорость потока описывает теплообмен в слое для широкого класса задач Численное решение уточняет поведение системы".split(),
}
FORWARD = {
    "utf8 as cp1252": lambda s: s.encode("utf-8").decode("cp1252"),
    "utf8 as mac_roman": lambda s: s.encode("utf-8").decode("mac_roman"),
    "utf8 as cp850": lambda s: s.encode("utf-8").decode("cp850"),
    "utf8 as cp1252 twice": lambda s: s.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252"),
    "cp1250 as cp1252": lambda s: s.encode("cp1250").decode("cp1252"),
    "koi8_r as cp1251": lambda s: s.encode("koi8_r").decode("cp1251"),
    "cp1251 as mac_roman": lambda s: s.encode("cp1251").decode("mac_roman"),
    "utf8 as latin1, controls dropped": lambda s: "".join(c for c in s.encode("utf-8").decode("latin-1") if not "\x80" <= c < "\xa0"),
}


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(25))


def corpus(rng, n=400):
    return [(i, sentence(rng, lang), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def found_in(spark, scratch, docs, **more):
    df = spark.createDataFrame([(i, t, "x", ["y"]) for i, t, *_ in docs], "doc_id bigint, text string, span string, spans array<string>")
    return df, find_garbled(df, scratch, **more)


def test_found_and_restored(spark, scratch):
    rng = random.Random(1)
    docs, truth = corpus(rng), {}
    i = 1_000
    for name, forward in FORWARD.items():
        for lang in WORDS:
            clean = sentence(rng, lang)
            try:
                bad = forward(clean)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if bad != clean:
                docs.append((i, bad, lang))
                truth[i] = (clean, name)
                i += 1
    df, g = found_in(spark, scratch, docs)
    got = {r["doc_id"] for r in g.documents.collect()}
    assert got == set(truth)
    back = {r["doc_id"]: r["restored"] for r in restore(df, g).collect()}
    exact = [d for d, (clean, name) in truth.items() if "dropped" not in name and back[d] == clean]
    assert len(exact) >= 0.8 * sum("dropped" not in name for _, name in truth.values())
    similar = [np.mean([a == b for a, b in zip(back[d].split(), clean.split(), strict=True)]) for d, (clean, name) in truth.items()]
    assert np.mean(similar) > 0.95


def test_one_word_in_a_clean_text(spark, scratch):
    docs = corpus(random.Random(2))
    docs.append((2_000, docs[0][1] + " " + "Störung".encode().decode("cp1252"), "de"))
    docs.append((2_001, docs[1][1] + " an�lisis", "fr"))
    _, g = found_in(spark, scratch, docs)
    assert {r["doc_id"]: r["lost"] for r in g.documents.collect()} == {2_000: False, 2_001: True}


def test_shown_on_purpose(spark, scratch):
    docs = corpus(random.Random(3))
    shown = ["\\verb+Ã¼ber+", "\\texttt{â€œokâ€\x9d}", "\\begin{verbatim}\nÃ© \ufffd\n\\end{verbatim}", "\\verb|Ã©| statt \\verb|é|"]
    docs += [(3_000 + i, f"{docs[i][1]} {s} Text", "de") for i, s in enumerate(shown)]
    _, g = found_in(spark, scratch, docs)
    assert g.documents.count() == 0


def test_null_empty_long_repeated(spark, scratch):
    docs = corpus(random.Random(4), 200)
    docs += [(4_000, None, ""), (4_001, "", ""), (4_002, "plain ascii", ""), (None, "GrÃ¶ÃŸe", "")] + [(4_003, "Wörter " * 50_000 + "fÃ¼r", "de")] * 2
    _, g = found_in(spark, scratch, docs)
    assert [r["doc_id"] for r in g.documents.collect()] == [4_003]
    _, none = found_in(spark, scratch, [])
    assert none.documents.count() == 0


def test_candidates_and_spans():
    assert ("für", "utf_8>cp1252", 0) in candidates("fÃ¼r")
    assert any(c[0] == "für" and c[1].count("utf_8>cp1252") == 2 for c in candidates("für".encode().decode("cp1252").encode().decode("cp1252")))
    assert spans_of("abc dé-fü \\verb|Ã¼| x\ufffdy") == (["dé", "fü", "x\ufffdy"], True)
    assert spans_of("") == ([], False)


def test_model_scores_what_it_was_trained_on_higher():
    m = NgramModel(*(t.astype(np.float32) for t in NgramModel.count(["für", "über", "größe"], [50, 40, 30])))
    a, b = m.scores(["für", "fÃ¼r"])
    assert a > b + 10
    # A span seen once counts as unseen when its own training is left out.
    once = NgramModel(*(t.astype(np.float32) for t in NgramModel.count(["für", "qxö"], [50, 1])))
    assert once.scores(["qxö"], np.array([1.0]))[0] < once.scores(["qxö"])[0]


@pytest.mark.parametrize("codec", ["cp1252", "cp1251", "mac_roman", "cp850", "koi8_r"])
def test_every_utf8_reading_is_undone(codec):
    word = "größerэто"
    bad = "".join(bytes([b]).decode(codec, errors="replace") for b in word.encode("utf-8"))
    if "\ufffd" not in bad:
        assert any(c[0] == word for c in candidates(bad))


def test_one_word_between_single_byte_encodings(spark, scratch):
    docs = corpus(random.Random(5))
    words = {"cp1251": "fréquence", "cp850": "Störung", "mac_roman": "contrôle", "koi8_r": "méthode"}
    for i, (codec, word) in enumerate(words.items()):
        docs.append((5_000 + i, f"{docs[i][1]} {word.encode('cp1252').decode(codec)}", "xx"))
    # Rare but right: a sign, an initial and a line of a tree on their own.
    docs += [(5_100 + i, f"{docs[i][1]} {sign} x", "xx") for i, sign in enumerate(("°", "Ж", "├──"))]
    _, g = found_in(spark, scratch, docs)
    assert {r["doc_id"] for r in g.documents.collect()} == {5_000, 5_001, 5_002, 5_003}


def test_what_does_not_belong_in_a_word():
    assert all(foreign(s) for s in ("tempйrature", "Gr÷áe", "107ñ587", "mÈthode"))
    assert not any(foreign(s) for s in ("température", "Größe", "107–587", "Éole", "теплообмен", "l’écart"))
    assert a_word("mé") and not a_word("├──") and not a_word("Ж")


def test_a_shared_slot_gains_nothing():
    # Every slot is taken by something common: what was never seen is still not likely.
    n3, n2, n1 = (t.astype(np.float32) for t in NgramModel.count(["für", "über"], [500, 400]))
    full = NgramModel(np.full_like(n3, 1e6), np.full_like(n2, 1e6), n1)
    assert full.scores(["f┬r"])[0] < full.scores(["für"])[0] - 10


def test_margins_follow_what_leaves_the_training(spark, scratch):
    # The garbled words are common at first, but for two texts all that hold them are given away by a lost character.
    docs = [(i, t, x) for i, t, x in corpus(random.Random(6)) if x != "ru"]
    words = "Численное решение уточняет поведение".split()
    bad = " ".join(w.encode("iso8859_5").decode("cp1252") for w in words)  # no chain leads back
    docs += [(6_000 + i, " ".join(words), "ru") for i in range(4)]
    docs += [(6_100 + i, f"{bad} an�lisis", "ru") for i in range(400)]
    docs += [(6_900 + i, bad, "ru") for i in range(2)]
    _, g = found_in(spark, scratch, docs)
    assert {r["doc_id"] for r in g.documents.filter("NOT lost").collect()} == {6_900, 6_901}


def test_evidence_counts_for_every_chain_that_gives_the_text(spark, scratch):
    assert any("cp1250>mac_roman" in c[1].split("|") and "cp1252>mac_roman" in c[1].split("|") for c in candidates("ogólny".encode("cp1250").decode("mac_roman")))
    docs = [(i, f"{t} ogólny równania", x) for i, t, x in corpus(random.Random(7))]
    # Two words with a letter that the encodings share, two with Polish letters only: three or more for cp1250 alone.
    docs.append((7_000, "ogólny równania łączną część".encode("cp1250").decode("mac_roman"), "pl"))
    _, g = found_in(spark, scratch, docs, margins=(500.0, 500.0))
    assert [(r["doc_id"], r["chain"]) for r in g.documents.collect()] == [(7_000, "cp1250>mac_roman")]


@pytest.mark.parametrize("whole, reading", [("Gr\u0489\u0488e", "Größe"), ("größe", "größe")])
def test_dropped_bytes_are_filled_in_beside_a_whole_reading(whole, reading):
    class Shared:
        value = tuple(t.astype(np.float32) for t in NgramModel.count(["Größe", "größe", "für"], [50, 200, 40]))

    span = "".join(c for c in "Größe".encode().decode("latin-1") if not "\x80" <= c < "\xa0")
    columns = [pa.array([span]), pa.array([1]), pa.array([[whole]]), pa.array([["utf_8>cp850"]]), pa.array([[0]], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["span", "n", "texts", "chains", "kinds"])
    (out,) = _scorer(Shared)([batch])
    assert out["text0"].to_pylist() == [reading]


def test_one_rare_word_between_single_byte_encodings(spark, scratch):
    docs = corpus(random.Random(5))
    # Words that no text has, so that they are likelier by less than 25.
    docs += [(8_000 + i, f"{docs[i][1]} {w}", "xx") for i, w in enumerate(("йnergie", "W÷rter", "Prьfung"))]
    _, g = found_in(spark, scratch, docs)
    assert {r["doc_id"] for r in g.documents.collect()} == {8_000, 8_001, 8_002}


LETTERS = {"cp1251": "длинное", "koi8_r": "длинное", "cp866": "длинное", "iso8859_5": "длинное", "cp1253": "μέθοδος", "iso8859_7": "μέθοδος", "cp1254": "değişim", "cp1250": "łączną", "iso8859_2": "łączną", "cp1257": "žemė"}


@pytest.mark.parametrize("written", WRITTEN_IN)
def test_every_chain_between_single_bytes_is_undone(written):
    """Wherever reading wrongly keeps all characters, the reading is among the candidates."""
    word, undone = LETTERS.get(written, "größère"), 0
    for read in READ_AS:
        bad = "".join(byte_table(read)[b] for b in word.encode(written))
        if bad != word and not any("\x7f" <= ch < "\xa0" for ch in bad):
            assert word in {text for text, _, _ in candidates(bad)}, (written, read, bad)
            undone += 1
    assert undone >= 6


@pytest.mark.parametrize("read", READ_AS)
def test_every_wrong_reading_of_utf8_is_undone(read):
    for word in ("système", "größe", "łączną", "длинное", "μέθοδος"):
        bad = "".join(byte_table(read)[b] for b in word.encode("utf-8"))
        assert word in {text for text, _, _ in candidates(bad)}


def test_latin9_readings_are_told_from_others(spark, scratch):
    docs = corpus(random.Random(8))
    words = "système contrôle frontière méthode fréquence"
    docs += [(i, f"{t} {words}", x) for i, t, x in corpus(random.Random(9), 60)]
    docs = [(n, t, x) for n, (_, t, x) in enumerate(docs)]
    docs.append((9_000, " ".join(words.split() * 4).encode().decode("iso8859_15"), "fr"))
    df, g = found_in(spark, scratch, docs)
    assert [r["restored"].split()[:5] for r in restore(df, g).collect()] == [words.split()]


def test_verbatim_environments_are_text_that_was_decoded(spark, scratch):
    docs = corpus(random.Random(10))
    tree = "\\begin{verbatim}\nrun\n├── mesh.dat\n└── flow.log\n\\end{verbatim}"
    docs += [(9_100 + i, f"{t} {tree}", x) for i, t, x in corpus(random.Random(11), 40)]
    docs.append((9_200, f"Only ASCII around. {tree}".encode().decode("latin_1"), "en"))
    docs.append((9_201, f"Only ASCII around. {tree}\n\\begin{{verbatim}}\nÃ©\n\\end{{verbatim}}", "en"))
    df, g = found_in(spark, scratch, docs)
    assert {r["doc_id"]: r["restored"] for r in restore(df, g).collect()} == {9_200: f"Only ASCII around. {tree}"}


def test_shown_parts_are_scored_and_reported_apart(spark, scratch):
    docs = corpus(random.Random(3))
    docs.append((9_300, f"{docs[0][1]} \\verb+Ã¼ber+ Text", "de"))
    _, g = found_in(spark, scratch, docs)
    assert g.documents.count() == 0
    assert [(r["doc_id"], r["span"], r["text"]) for r in g.shown.collect()] == [(9_300, "Ã¼ber", "über")]


def test_filling_is_exact():
    """Against all readings of short spans."""
    model = NgramModel(*(t.astype(np.float32) for t in NgramModel.count(["größe", "Größe", "für", "über", "Übung", "öß"], [50, 20, 40, 30, 10, 9])))
    keys = model.lossy_keys()["latin_1"]

    def readings(span):
        if not span:
            return [""]
        return [ch + rest for n, ch in [(1, span[0])] + [(n, ch) for n in (1, 2, 3, 4) if n <= len(span) for ch in keys.get(span[:n], ())] for rest in readings(span[n:])]

    for word in ("größe", "Übung", "öß", "für über".replace(" ", "")):
        span = "".join(c for c in word.encode().decode("latin-1") if not "\x80" <= c < "\xa0")
        best = max((float(sum(model.step(("\x02\x02" + r + "\x03")[i : i + 3]) for i in range(len(r) + 1))), r) for r in set(readings(span)) if r != span)
        assert model.fill(span, keys) == best[1]


def test_control_characters_are_telling(spark, scratch):
    docs = [(i, f"{t} a – b", x) for i, t, x in corpus(random.Random(12))]
    docs.append((9_400, "plain words \x96 and more", "en"))
    df, g = found_in(spark, scratch, docs)
    assert [r["restored"] for r in restore(df, g).collect()] == ["plain words – and more"]


def test_made_cases_are_counted_by_chain(spark, scratch):
    docs = corpus(random.Random(13), 200)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id bigint, text string, chain string")
    found = {(r["chain"], r["wholly"]): r for r in made_cases(df, scratch, sample=120).collect()}
    utf8 = [r for (chain, _), r in found.items() if chain.startswith("utf_8")]
    assert 100 <= sum(r["made"] for r in found.values()) <= 120 and all(r["restored"] <= r["found"] <= r["made"] for r in found.values())
    assert sum(r["found"] for r in utf8) == sum(r["made"] for r in utf8) > 0
    assert misread("für", "utf_8", "cp1252") == "fÃ¼r" and misread("für", "cp1251", "cp866") is None and misread("abc", "utf_8", "cp1252") is None
    assert made_cases(df.limit(0), scratch).count() == 0
