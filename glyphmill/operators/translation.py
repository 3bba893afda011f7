"""Translation by a model behind a callable: messages, responses, retries, stripping, terms and rule books."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import NEWLINE
from glyphmill.functions.udfs import escape_special, exploded, scalar, unescape_special
from glyphmill.operators.batches import greedy_chunks
from glyphmill.operators.model import RETRIES, Model, Settings, chat, prompted, terms_prompt, translation_prompt
from glyphmill.parse import component, rules

# This project's own marks of the messages to and from a model.
START, TRANSLATED, TERMS, END = (f"-- BATCH:{x} --" for x in ("START", "TRANSLATED", "TERMS", "END"))
_RESPONSE = re.compile(rf"{TRANSLATED}(.*?){TERMS}(.*?){END}", re.S)
_LINE = re.compile(r"\s*\[(\d+)\] ?(.*)")


class ResponseError(ValueError):
    pass


def message(texts: list[str], terms: dict[str, str]) -> str:
    """The terms that apply, the start mark, and the numbered texts, one a line."""
    joined = "\n".join(texts).lower()
    own = [f"{a} => {b}" for a, b in terms.items() if a.lower() in joined]
    return "\n".join([*own, START, *(f"[{i}] {t.replace(chr(10), NEWLINE)}" for i, t in enumerate(texts))])


def parse_response(response: str, size: int) -> tuple[list[str | None], dict[str, str]]:
    """(texts by number, new terms). Missing numbers are None, of repeated ones the last counts; ResponseError if the form is wrong."""
    found = _RESPONSE.search(response)
    if not found:
        raise ResponseError("marks are missing")
    out: list[str | None] = [None] * size
    for line in found[1].split("\n"):
        m = _LINE.fullmatch(line)
        if m:
            if int(m[1]) >= size:
                raise ResponseError(f"line {m[1]} of {size}")
            out[int(m[1])] = m[2].replace(NEWLINE, "\n")
    try:
        terms = json.loads(found[2].strip() or "{}")
    except json.JSONDecodeError as e:
        raise ResponseError(str(e)) from None
    if not isinstance(terms, dict):
        raise ResponseError("terms aren't an object")
    return out, {k: str(v) for k, v in terms.items()}


def response_lines(frame: DataFrame, response: str, size: str) -> DataFrame:
    """One row per expected text of each response: i, translated (null if missing); none for malformed ones."""

    def run(text: str | None, n: int):
        try:
            return [{"i": i, "translated": t} for i, t in enumerate(parse_response(text or "", int(n))[0])]
        except ResponseError:
            return []

    return exploded(frame, run, "i int, translated string", response, size)


def stripped(frame: DataFrame, text: str, fmt: str) -> DataFrame:
    """With strip_kind, strip_text and is_single_list: what of each text is to be translated."""

    def run(value: str, kind: str) -> dict:
        return dict(zip(("strip_kind", "strip_text", "is_single_list"), component.strip(value, kind), strict=True))

    @F.pandas_udf("strip_kind string, strip_text string, is_single_list boolean")
    def made(values: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run(v, k) for v, k in zip(values, kinds, strict=True)], columns=["strip_kind", "strip_text", "is_single_list"])

    return frame.withColumn("_s", made(text, fmt)).select(*frame.columns, "_s.*")


def destripped(frame: DataFrame, text: str, fmt: str, translated: str, column: str = "target") -> DataFrame:
    """With ``column``: each translation put back into the component that its text was stripped from."""
    return frame.withColumn(column, scalar(component.destrip, "string", text, fmt, translated))


def validate(text: str, fmt: str) -> bool:
    """Whether a text is what its format says: NBT and JSON formats ask for a component."""
    if fmt in ("snbt_str", "nbt_obj"):
        return component.is_text(component.read_snbt(text))
    if fmt in ("json_str", "json_obj"):
        found = component.read_json(text)
        return component.is_text(found)
    return True


def translate_chunk(texts: list[str], fmt: str, terms: dict[str, str], model: Model, retries: int = RETRIES) -> tuple[list[tuple[str, str | None, str]], dict[str, str]]:
    """((text, target, status) of each, new terms) of one chunk; no call if there is nothing to translate.

    Asks again, up to ``retries`` times, where a call fails, the answer is malformed or a whole component isn't one.
    """
    strips = [component.strip(escape_special(t), fmt) for t in texts]
    asked = [i for i, s in enumerate(strips) if s[0] != "untranslatable"]

    def read(answer: str) -> tuple[list[str | None], dict[str, str]]:
        answers, learnt = parse_response(answer, len(asked))
        if any(a and strips[i][0] == "cannot_strip" and not validate(a, fmt) for i, a in zip(asked, answers, strict=True)):
            raise ResponseError("an answer isn't a component")
        return answers, learnt

    answers, learnt = chat(model, message([strips[i][1] for i in asked], terms), read, retries) if asked else ([], {})
    got = dict(zip(asked, answers, strict=True))
    out = []
    for i, (text, s) in enumerate(zip(texts, strips, strict=True)):
        if s[0] == "untranslatable":
            out.append((text, None, "untranslatable"))
        else:
            target = component.destrip(escape_special(text), fmt, got[i])
            out.append((text, None if target is None else unescape_special(target), "translated" if target is not None else "untranslated"))
    return out, learnt


def translate(pool: DataFrame, model: Model, terms: dict[str, str] | None = None, budget: int = 2048, retries: int = RETRIES) -> DataFrame:
    """(format, source, target, status) of a pool(format, text): chunks by budget, each sent to the model as one message.

    Terms are frozen, so chunks run in parallel; :func:`translate_in_turn` passes on learnt terms. A format's
    texts are dealt out by hash to as many parts as a shuffle has, and chunked in each of these.
    """
    fixed = dict(terms or {})
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pool.select(F.concat("format", F.lit("|"), F.pmod(F.xxhash64("text"), F.lit(parts))).alias("format"), "text")
    chunks = greedy_chunks(dealt, "format", "text", budget=budget)

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None

        def send():
            fmt = at[0].rpartition("|")[0]
            rows, _ = translate_chunk([t for _, t in held], fmt, fixed, model, retries)
            return pd.DataFrame([(fmt, *r) for r in rows], columns=["format", "source", "target", "status"])

        for part in groups:
            for f, t, c in zip(part["format"], part["text"], part["chunk"], strict=True):
                if at is not None and (f, c) != at:
                    yield send()
                    held = []
                at = (f, c)
                held.append((f, t))
        if held:
            yield send()

    return chunks.mapInPandas(run, "format string, source string, target string, status string")


def translate_in_turn(chunks: Iterable[tuple[str, list[str]]], model: Model, terms: dict[str, str], retries: int = RETRIES) -> Iterator[tuple[list[tuple[str, str | None, str]], dict[str, str]]]:
    """Results of chunks (format, texts) one after the other; terms that one teaches apply to the next. What came out stays valid if a later one fails."""
    known = dict(terms)
    for fmt, texts in chunks:
        rows, learnt = translate_chunk(texts, fmt, known, model, retries)
        known |= learnt
        yield rows, dict(known)


def translate_to(pool: DataFrame, model: Model, path: str, settings: Settings | None = None) -> dict[str, str]:
    """Translate a pool(format, text) into a table at ``path``, chunk after chunk, and give the terms known in the end.

    Each chunk's results are appended before the next is asked for, so a run that fails keeps what is done;
    a run begun again leaves out what the table has. Chunks come to the driver one at a time.
    """
    settings, spark = settings or Settings(), pool.sparkSession
    schema = "format string, source string, target string, status string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done = spark.read.schema(schema).parquet(path).where("status <> 'untranslated'")
    rest = pool.select("format", "text").join(done.select("format", F.col("source").alias("text")), ["format", "text"], "left_anti")
    rest = rest.distinct().persist()
    asked = prompted(model, translation_prompt(settings, (START, TRANSLATED, TERMS, END)))

    def chunks() -> Iterator[tuple[str, list[str]]]:
        at, held = None, []
        for r in greedy_chunks(rest, "format", "text", budget=settings.budget).orderBy("format", "chunk", "text").toLocalIterator():
            if held and (r.format, r.chunk) != at:
                yield at[0], held
                held = []
            at = (r.format, r.chunk)
            held.append(r.text)
        if held:
            yield at[0], held

    known = dict(settings.terms)
    try:
        both = zip_kept(chunks(), lambda part: translate_in_turn(part, asked, dict(settings.terms), settings.retries))
        for (fmt, _), (rows, known) in both:
            spark.createDataFrame([(fmt, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
    finally:
        rest.unpersist()
    return known


def zip_kept(items: Iterable, function: Callable[[Iterable], Iterable]) -> Iterator[tuple]:
    """Each item with what ``function``, which goes through the items one by one, gives for it."""
    held: list = []

    def tap():
        for x in items:
            held.append(x)
            yield x

    for result in function(tap()):
        yield held.pop(0), result


def exported(results: DataFrame) -> DataFrame:
    """A mapping of results: translated texts, and untranslatable ones with a null target; untranslated ones are left out."""
    return results.where("status <> 'untranslated'").select("source", "target")


def named_terms(text: str, model: Model, retries: int = RETRIES) -> dict[str, str]:
    """The terms that a model names for a text; blank ones don't count."""

    def read(answer: str) -> dict[str, str]:
        found = json.loads(answer)
        if not isinstance(found, dict):
            raise ResponseError("terms aren't an object")
        return {k: v for k, v in found.items() if k.strip() and isinstance(v, str) and v.strip()}

    return chat(model, text, read, retries)


def extract_terms(texts: list[list[str]], model: Model, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Terms that a model names for chunks of texts, one JSON object each, over the defaults."""
    out = dict(defaults or {})
    for chunk in texts:
        out |= named_terms("\n".join(chunk), model)
    return out


def terms_of(pool: DataFrame, model: Model, defaults: dict[str, str] | None = None, budget: int = 2048, settings: Settings | None = None) -> DataFrame:
    """(term, meaning) of a pool(text): chunks by budget go to the model in parallel, the last chunk that names a term wins, over the defaults."""
    retries = settings.retries if settings else RETRIES
    asked = prompted(model, terms_prompt(settings)) if settings else model
    chunks = greedy_chunks(pool.select(F.lit("").alias("format"), "text"), "format", "text", budget=budget)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def send():
            found = named_terms("\n".join(held), asked, retries)
            return pd.DataFrame([(at, k, v) for k, v in found.items()], columns=["chunk", "term", "meaning"])

        for part in parts:
            for text, chunk in zip(part["text"], part["chunk"], strict=True):
                if held and chunk != at:
                    yield send()
                    held = []
                at = chunk
                held.append(text)
        if held:
            yield send()

    found = chunks.mapInPandas(run, "chunk long, term string, meaning string")
    given = pool.sparkSession.createDataFrame([(-1, k, v) for k, v in (defaults or {}).items()], "chunk long, term string, meaning string")
    return found.unionByName(given).groupBy("term").agg(F.max_by("meaning", "chunk").alias("meaning"))


def by_rules(pool: DataFrame, book: rules.RuleBook) -> DataFrame:
    """(source, target) of a pool(text) by a rule book: the first rule of the text's shape, else its raw line; else a null target.

    Shapes are keys, so rules are looked up and not tried one by one; the book travels with the task.
    """
    first: dict[str, rules.Shape] = {}
    for left, right in book.rules:
        first.setdefault(rules.render(left), right)
    raw = dict(book.raw)

    @F.pandas_udf("string")
    def target(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            shape = rules.key(text)
            new = rules.translate(text, first[shape]) if shape in first else None
            return raw.get(text) if new is None else new

        return texts.map(one, na_action="ignore").astype(object)

    return pool.select(F.col("text").alias("source"), target("text").alias("target"))
