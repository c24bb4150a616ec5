import pytest

from bitloom.llm import pairs as P

EN = ["Check the local pumps before the looms are started, as described in section 9.", "If Vela agrees, the system records 63 valves for each of the pumps.",
      "In most cases, do not store the looms next to pumps because the valves are small."]
DE = ["Prüfen Sie die örtlichen Pumpen, bevor die Webstühle gestartet werden, wie in Abschnitt 9 beschrieben.", "Falls Vela zustimmt: das System erfasst 63 Ventile für jede der Pumpen.",
      "In den meisten Fällen gilt: lagern Sie die Webstühle nicht neben Pumpen, weil die Ventile klein sind."]
ZH = ["请在启动织机之前检查本地的水泵，如第9节所述。", "如果Vela同意，系统为每个水泵记录63条阀门。", "在大多数情况下，请勿将织机存放在水泵旁边，因为阀门是小型的。"]
ES = ["Revise las bombas locales antes de arrancar los telares, como se describe en la sección 9.", "Si Vela está de acuerdo, el sistema registra 63 entradas de las válvulas."]
MODEL = P.language_model([(lang, t) for lang, ts in (("en", EN), ("de", DE), ("zh", ZH), ("es", ES)) for t in ts * 3])


def defects(source, target, sl="en", tl="de"):
    return P.examine(source, target, sl, tl, MODEL)


@pytest.mark.parametrize("target", [None, "", " ", "…", "​", "---", "“”", "()"])
def test_empty(target):
    assert defects(EN[0], target) == ["empty"]


@pytest.mark.parametrize("source,target", list(zip(EN, DE)))
def test_sound(source, target):
    assert defects(source, target) == [] == defects(target, source, "de", "en")


@pytest.mark.parametrize("text", ["I'm sorry, but I can't translate this text", "I cannot assist with that request.", "抱歉,我无法翻译这段内容。", "对不起,这个请求我帮不了您!",
                                  "Es tut mir leid, diesen Text kann ich nicht übersetzen", "Ich muss die Übersetzung dieses Segments ablehnen.", "No me es posible ayudar con esta petición",
                                  "Debo rechazar la traducción de este segmento", "Unfortunately this content goes against my guidelines", "由于缺少上下文,我拒绝继续翻译!"])
def test_refusal(text):
    assert defects(EN[0], text)[0] == "refusal"


def test_rendered_refusals_are_sound():
    assert "refusal" not in defects('"I cannot answer that," replied Vela.', "„Das kann ich nicht beantworten“, sagte Vela.")
    assert "refusal" not in defects("We are sorry, we cannot help with pumps.", "Es tut uns leid, bei Pumpen können wir nicht helfen.")
    assert "refusal" not in defects("I refuse to translate this text.", "I refuse to translate this text, sagte er.")


def test_copy():
    assert defects(EN[0], EN[0].upper().rstrip("."))[0] == "copy" == defects(EN[0], f"  {EN[0]}\n")[0]
    for kept in ("`vela --limit 51`", "https://vela.example.invalid/9", "2 × 9 mm", "vela:22", "| 23 | HT-23 |", "HB-81", "vela_20.json", "```sh\nvela -n 9 | sort\n```", "12"):
        assert defects(kept, kept) == [], kept


def test_wrong_language():
    assert defects(EN[0], ZH[0]) == ["wrong_language"] == defects(EN[1], ES[1])
    assert defects(ZH[2], DE[2], "zh", "en") == ["wrong_language"]
    assert defects(EN[0], DE[0], "en", "fr") == [] == defects(EN[0], DE[0], None, None)


@pytest.mark.parametrize("cut", [DE[0][:40], DE[0][:40] + "...", DE[0][:40] + " …", DE[0][:40] + ",", DE[0][:40] + " -", "Prüfen Sie die Pumpen"])
def test_truncated(cut):
    assert defects(EN[0], cut) == ["truncated"]


def test_missing_sentences_and_omitted_asides():
    assert defects(" ".join(EN), " ".join(DE[:2])) == ["truncated"]
    assert defects(EN[0], "Prüfen Sie die örtlichen Pumpen, bevor die Webstühle gestartet werden.") == []
    assert defects("The server of Vela answers...", "恢复期间,Vela的服务器返回……", "en", "zh") == []
    assert defects("Check (the pumps).", "Prüfen Sie (die Pumpen.") == ["truncated", "unclosed_delimiter"]


def test_every_triggered_type_comes_out():
    assert defects(EN[0], EN[0] + " " + DE[0]) == ["copied_prefix"]
    assert defects(EN[1], EN[1] + " Sie sagen (mehr dazu") == ["wrong_language", "truncated", "unclosed_delimiter", "copied_prefix"]
    assert defects(EN[0], EN[0], "en", "zh") == ["copy", "wrong_language"]
    assert defects(EN[0], "I cannot assist with that request.", "en", "zh")[:1] == ["refusal"]
    assert "copied_prefix" not in defects("Vela Kito HB-81 Sola", "Vela Kito HB-81 Sola und mehr davon.")
    assert defects("Überblick über alle Pumpen", "ÜBERBLICK ÜBER ALLE PUMPEN.", "de", "fr") == ["copy"]


def test_found(spark):
    schema = "unit_key long, file_id long, source_lang string, target_lang string, source string, target string, sl string, defects string"
    rows = [(1, 1, " en-US", "de_DE", EN[0], None), (2, 1, "EN-us", "DE", EN[0], DE[0]), (3, 1, "en", "de", EN[0], "Page not found"), (4, 2, "en", "de", EN[0], None),
            (5, 1, None, None, None, None), (6, 1, "en", "de", None, DE[0]), (7, 1, "en", "de", EN[0], EN[0]), (8, 1, "en", "de", EN[0], EN[0]), (9, 9, "en", "de", EN[0], ""),
            (10, 1, "en", "de", EN[0] * 2000, DE[0] * 2000)]
    units = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    files = spark.createDataFrame([(1, "paired"), (2, "raw_import"), (1, "paired"), (3, None)], "file_id long, layout string")
    assert sorted(map(tuple, P.found(units, files).collect())) == [(1, "empty"), (5, "empty"), (7, "copy"), (8, "copy")]
    assert {r.unit_key: r.defects for r in P.defects(units, files).collect()} == {1: ["empty"], 5: ["empty"], 7: ["copy"], 8: ["copy"]}
    assert P.found(units.limit(0), files).count() == P.found(units, files.limit(0)).count() == 0


def test_sources_that_decline_nothing_suppress_no_refusal():
    for source in ("The file cannot be opened.", "Users are unable to see the guidelines.", "Vela can't store 63 valves."):
        assert defects(source, "I'm sorry, but I can't translate this text.")[0] == "refusal", source
    assert defects("Leider ist die Datei leer.", "I cannot assist with that request.", "de", "en")[0] == "refusal"
    assert defects("如果无法打开文件,请重试。", "I cannot assist with that request.", "zh", "en")[0] == "refusal"
    assert "refusal" not in defects("Vela cannot open it.", "Vela is unable to process it.")


def test_texts_that_begin_differently_are_not_compared_whole(monkeypatch):
    compared = []
    whole = P._copy_key
    monkeypatch.setattr(P, "_copy_key", lambda text: compared.append(text) or whole(text))
    assert defects(EN[0], DE[0]) == [] and not compared
    assert defects("ẞeta pumps", " SSETA  pumps.")[0] == "copy" and compared


def test_language_model_counts_every_cell(spark, monkeypatch):
    # one German cell in a thousand English ones, and a language that few rows have: a sample of the rows would miss most of it
    rows = [(i, "en-GB", EN[i % 3]) for i in range(45_000)] + [(50_000 + i, "de", DE[i % 3]) for i in range(45)] + [(60_000, None, ES[0]), (60_001, "es", None), (60_002, "fr", "pompes")]
    units = spark.createDataFrame(rows, "unit_key long, source_lang string, source string")
    model = P.fit_languages(units)
    assert model.logs == P.language_model([((lang or "")[:2], t) for _, lang, t in rows if t]).logs and "webstühle" in model.logs and "pompes" not in model.logs
    assert {w: P.LANGUAGES[v.index(max(v))] for w, v in model.logs.items() if w in ("webstühle", "looms")} == {"webstühle": "de", "looms": "en"}
    monkeypatch.setattr(P, "WORDS_HELD", 1)
    assert P.fit_languages(units).logs == model.logs
    assert P.fit_languages(units.limit(0)).logs == {}


def test_words_are_counted_as_in_bare_texts():
    texts = ["Open `vela --limit` now.", "a < b", "c > d", "https://vela.example/9 pumps", "{{ name }} pumps {", "HB-81, x:y 4.2 50%s", "Ärzte/Ämter:Pumpen", "请在第9节 vela@x.y", "İx Σας ΣΑΣ", "", " \n"] * 3
    from collections import Counter

    assert P.count_words(texts) == Counter(w for t in texts for w in P._TOKEN.findall(P.bare(t).lower()))
