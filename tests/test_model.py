import hashlib
import json
import logging

import pytest

from glyphmill.operators import model as m
from glyphmill.operators import translation as t
from glyphmill.parse import njson, regex, textmodel
from glyphmill.parse.tree import Num
from glyphmill.sources import languages

from . import fake_model


def test_retries():
    answers = iter([m.ApiError("limit"), OSError("broken"), "bad", ["go", "od"]])

    def model(text):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    def read(answer):
        if answer != "good":
            raise ValueError(answer)
        return answer

    pieces = []
    assert m.chat(model, "x", read, 4, sign=pieces.append) == "good" and pieces == ["bad", "go", "od"]
    calls = []
    with pytest.raises(m.RetryError):
        m.chat(lambda x: calls.append(x) or "bad", "x", read, 3)
    assert len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        m.chat(lambda x: 1 / 0, "x", read)


def test_settings_and_prompts():
    own = m.Settings("a", target="de_de", about="An island.", style="short")
    prompt = m.translation_prompt(own, (t.START, t.TRANSLATED, t.TERMS, t.END))
    assert all(x in prompt for x in (t.START, t.TRANSLATED, t.TERMS, t.END, "de_de", "An island.", "short"))
    assert "de_de" in m.terms_prompt(own) and m.prompted(lambda x: x, "P")("q") == "P\n\nq"
    assert own.checked(["a", "b"]) is own
    for bad in ({"temperature": 2.1}, {"temperature": -0.1}, {"budget": 0}):
        with pytest.raises(ValueError):
            m.Settings(**bad)
    with pytest.raises(ValueError):
        own.checked(["b"])
    answers = iter([" ", " better "])
    assert m.better_prompt(lambda x: next(answers), "P") == "better"
    assert m.named("tests.fake_model:terms")("a Bob") == '{"Bob":"BOB"}'


def test_progress_and_levels(caplog):
    heard = []
    progress = m.Progress().on(m.Step, heard.append).on(object, lambda e: heard.append("any"))
    progress.tell(m.Step(1, 2))
    progress.tell(m.Used(5))
    assert heard == [m.Step(1, 2), "any", "any"]
    log = m.logger("glyphmill.test", "debug", "error")
    with caplog.at_level(logging.DEBUG):
        for level in ("debug", "info", "warning", "error"):
            getattr(log, level)(level)
    assert [r.message for r in caplog.records if r.name == "glyphmill.test"] == ["debug", "error"]


def test_translation_into_a_table_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "done")
    pool = spark.createDataFrame([("plain_str", f"text {c} " + "x" * 30) for c in "abcdef"], "format string, text string")
    monkeypatch.setattr(fake_model, "FAIL_AT", ["text e"])
    settings = m.Settings(budget=50, retries=2)
    with pytest.raises(m.RetryError):
        t.translate_to(pool, fake_model.upper, path, settings)
    first = spark.read.parquet(path).count()
    assert 0 < first < 6
    fake_model.FAIL_AT.clear()
    t.translate_to(pool, fake_model.upper, path, settings)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 6 and all(r.target == r.source.upper() for r in rows)


def test_component_kinds():
    many = textmodel.read(["a", {"text": "b", "bold": Num("byte", 1)}])
    assert njson.write(many.tree()) == '["a",{"text":"b","bold":true}]'
    assert njson.write(textmodel.joined(many, [textmodel.read("c")]).tree()) == '["a",{"text":"b","bold":true},"c"]'
    for bad in ({}, {"odd": 1}, {"type": 3}, {"type": "text"}, {"type": "nothing"}, 3, None):
        with pytest.raises(textmodel.ComponentError):
            textmodel.read(bad)
    one = textmodel.read({"type": "translatable", "translate": "a", "with": ["x", {"text": "y"}], "font": "f"})
    assert one.kind == "translate" and one.tree() == {"type": "translatable", "translate": "a", "with": ["x", {"text": "y"}], "font": "f"}
    one.style["font"] = None
    assert "font" not in one.tree() and textmodel.with_text(one, "z").tree() == one.tree()
    assert textmodel.is_pure_key(textmodel.read({"translate": "a.b"})) and not textmodel.is_pure_key(textmodel.read({"translate": "a.b", "extra": "x"}))


def test_regex():
    p = regex.Pattern(r"(?<key>\w)(\d)?")
    assert [m.values for m in p.find_all("a1b")] == [["a1", "a", "1"], ["b", "b", ""]]
    found = p.find("-a1")
    assert (found.range, found.group("key"), p.find("b").group(2)) == ((1, 2), regex.Group("a", (1, 1)), None)
    assert regex.Pattern("").find("x").range == (0, -1) and [m.range for m in regex.Pattern("x*").find_all("ax")] == [(0, -1), (1, 1), (2, 1)]
    assert p.replace("a1b", "<${key}>") == "<a><b>" and p.replace("a1b", lambda m: m.value.upper()) == "A1B" and p.replace_first("a1b", r"\$$1") == "$ab"
    assert regex.Pattern.literal("a.b").matches("a.b") and not regex.Pattern.literal("a.b").matches("axb") and regex.Pattern(regex.escape("(")).contains("x(")
    assert regex.Pattern("x").replace("x", regex.escape_replacement(r"\$1")) == r"\$1"
    assert p.match_at("--a", 2).value == "a" and p.match_at("--a", 1) is None and p.entire("a1").values == ["a1", "a", "1"]
    assert regex.Pattern(",").split("a,,b,") == ["a", "", "b", ""] and regex.Pattern(",").split("a,b,c", 2) == ["a", "b,c"]
    with pytest.raises(IndexError):
        p.find("a", 2)


def test_language_files():
    files = {"de_de": b'{"k": "eins"}', "fr_fr": b'{"k": "un"}'}
    digest = lambda raw: hashlib.sha1(raw).hexdigest()
    objects = {f"minecraft/lang/{n}.json": {"hash": digest(raw)} for n, raw in files.items()} | {"minecraft/sounds.json": {"hash": "0" * 40}}
    index = json.dumps({"objects": objects}).encode()
    version = json.dumps({"assetIndex": {"url": "index", "sha1": digest(index)}}).encode()
    store = {languages.MANIFEST: json.dumps({"latest": {"release": "1.0"}, "versions": [{"id": "1.0", "url": "v", "sha1": digest(version)}]}).encode(), "v": version, "index": index}
    store |= {f"{languages.RESOURCES}/{digest(raw)[:2]}/{digest(raw)}": raw for raw in files.values()}
    assert dict(languages.language_files(get=store.__getitem__)) == {"de_de": {"k": "eins"}, "fr_fr": {"k": "un"}}
    assert dict(languages.language_files("1.0", ["fr_fr"], store.__getitem__)) == {"fr_fr": {"k": "un"}}
    with pytest.raises(languages.DownloadError):
        list(languages.language_files("0.9", get=store.__getitem__))
    with pytest.raises(languages.DownloadError):
        list(languages.language_files(get=(store | {"index": index + b" "}).__getitem__))
