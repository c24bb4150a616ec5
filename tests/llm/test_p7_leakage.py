import random
import re
import unicodedata

from bitloom.llm import leakage as L

WORDS = [f"{a}{b}" for a in ("al", "be", "co", "straße", "éa", "x1") for b in "rstuv"]
HAN = [chr(c) for c in range(0x4E00, 0x4E20)]


def brute(docs, items):
    def words(t):
        return [w.casefold() for w in re.findall(r"[^\W_]+", t or "")]

    out = set()
    for d, text in docs:
        dw = words(text)
        runs, letters = {tuple(dw[i : i + 12]) for i in range(len(dw) - 11)}, "".join(dw)
        for item, lang, t in items:
            w = words(t)
            if lang == "zh":
                c = "".join(w)
                if any(c[i : i + 24] in letters for i in range(len(c) - 23)):
                    out.add((d, item))
            elif any(tuple(w[i : i + 12]) in runs for i in range(len(w) - 11)):
                out.add((d, item))
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, hits string"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, item_lang string, item_text string, doc_id int"))


def test_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, "en" if i % 3 else "zh", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 25))) if i % 3 else "".join(rng.choice(HAN) for _ in range(rng.randrange(10, 40)))) for i in range(40)]
    docs = []
    for d in range(150):
        _, lang, text = rng.choice(items)
        if lang == "zh":
            a = rng.randrange(max(1, len(text) - 20))
            part = rng.choice(["", " ", "，", "''"]).join(text[a : a + rng.randrange(18, 30)])
        else:
            w = text.split()
            a = rng.randrange(len(w))
            part = rng.choice([" ", "  ", ", ", "''\n", " [["]).join(w[a : a + rng.randrange(9, 16)])
        docs.append((d, " ".join(rng.choice(WORDS) for _ in range(5)) + rng.choice([" ", "x"]) + rng.choice([part, part.upper()]) + rng.choice([" ", "y"]) + "end."))
    items += [(90, None, " ".join(WORDS[:14])), (91, "en", None), (92, "zh", ""), (90, "en", " ".join(WORDS[:14]))]
    docs += [(900, None), (901, ""), (902, "-".join(WORDS[:13])), (902, "-".join(WORDS[:13])), (903, "z " * 100_000 + " ".join(WORDS[1:14]))]
    df = frames(spark, docs, items)
    got = [tuple(r) for r in L.found(*df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and {(902, 90), (903, 90)} <= set(got)
    assert {r.item_id: r.documents for r in L.by_item(*df).collect()}[90] == 2


def test_offsets_and_word_ends():
    item = "one two three four five six seven eight nine ten eleven twelve"
    auto = L.automaton([(1, "en", item)])
    text = "Zuvor: '''ONE''' two  three, four five six seven eight nine ten eleven [[twelve]] danach"
    hits, a, b = L.scan(auto, text)[1]
    assert hits == 1 and text[a:b] == text[text.index("ONE") : text.index("]]")]
    assert L.scan(auto, item.replace("two three", "twothree")) == {} == L.scan(auto, item.replace("five", "fi ve")) == L.scan(auto, item + "s")
    assert L.scan(auto, "a " + item + " b") != {} and L.scan(L.automaton([]), item) == {}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 100)
    items = [(i, "en", " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)]
    docs = [(i, t) for i, _, t in items]
    df = frames(spark, docs, items)
    assert len(list(L.item_blocks(df[1]))) == 5
    assert sorted(map(tuple, L.found(*df).collect())) == [(i, i) for i in range(5)]
    assert L.found(df[0].limit(0), df[1]).count() == L.found(df[0], df[1].limit(0)).count() == 0


def test_offsets_refer_to_the_original():
    words = "uno dos tres cuatro cinco seis siete ocho nueve diez once café".split()
    item = " ".join(words)
    auto = L.automaton([(1, "es", item)])
    for before in ("café " * 10, "한, Å! " * 3):
        for form in ("NFC", "NFD"):
            for other in ("NFC", "NFD"):
                start, text = unicodedata.normalize(other, before), unicodedata.normalize(form, item)
                whole = start + text + " y él"
                assert L.scan(auto, whole) == {1: (1, len(start), len(start) + len(text))}, (start, text)


def test_blocks_are_passed_on_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 3000)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    items = spark.createDataFrame([(i, "en", " ".join(words[i * 15 : i * 15 + 15])) for i in range(40)], "item_id long, item_lang string, item_text string")
    blocks = L.item_blocks(items)
    assert iter(blocks) is blocks and len(list(blocks)) > 3
    docs = spark.createDataFrame([(7, " ".join(words[:30]) + " x " + " ".join(words[300:330]))], "doc_id long, text string")
    assert {tuple(r) for r in L.found(docs, items).collect()} == {(7, 0), (7, 1), (7, 20), (7, 21)}
