"""The language model behind a callable: settings, prompts, retries, answers in pieces, progress and log levels."""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import TypeVar

RETRIES = 20
T = TypeVar("T")
#: A model takes a prompt and a message, and gives its answer whole or in pieces.
Model = Callable[[str], "str | Iterable[str]"]


class ApiError(RuntimeError):
    """A call that failed for a reason that another try may not have: a timeout, a limit, a broken connection."""


class RetryError(RuntimeError):
    """No try succeeded."""


@dataclass(frozen=True)
class Settings:
    """What a translation run is given; the defaults are those of a plain run."""

    model: str = ""
    temperature: float = 0.3
    source: str = "en_us"
    target: str = "zh_cn"
    style: str = ""
    about: str = ""
    budget: int = 2048
    retries: int = RETRIES
    concurrency: int = 1
    terms: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.temperature <= 2:
            raise ValueError("the temperature must lie from 0 to 2")
        if min(self.budget, self.retries, self.concurrency) < 1:
            raise ValueError("budget, retries and concurrency must be 1 or more")

    def checked(self, known: Iterable[str]) -> Settings:
        """Itself, if the model is one of those known."""
        if self.model not in set(known):
            raise ValueError(f"no model {self.model!r}")
        return self


def whole(answer: str | Iterable[str], sign: Callable[[str], None] | None = None) -> str:
    """An answer in one piece; ``sign`` is told every piece as it comes."""
    if isinstance(answer, str):
        answer = [answer]
    parts = []
    for piece in answer:
        parts.append(piece)
        if sign:
            sign(piece)
    return "".join(parts)


def chat(model: Model, text: str, read: Callable[[str], T], retries: int = RETRIES, wait: float = 0.0, sign: Callable[[str], None] | None = None) -> T:
    """What ``read`` makes of the answer. Asks again after failed calls and after answers that read refuses (ValueError).

    RetryError, from the last failure, after so many tries; other errors come out at once.
    """
    last: Exception | None = None
    for attempt in range(retries):
        try:
            return read(whole(model(text), sign))
        except (ValueError, ApiError, OSError) as e:
            last = e
            logging.getLogger(__name__).warning("try %d of %d: %s", attempt + 1, retries, e)
            if wait and attempt < retries - 1:
                time.sleep(min(60.0, wait * 2**attempt))
    raise RetryError(f"{retries} tries failed") from last


def translation_prompt(settings: Settings, marks: tuple[str, str, str, str]) -> str:
    """Instructions for translating numbered lines, in the form that parse_response reads."""
    start, translated, terms, end = marks
    out = [
        f"You translate texts of a game world from {settings.source} to {settings.target}.",
        f"After the line {start} each line holds a number in brackets and a text. Lines before it, if any, give terms and their translations: use them.",
        f"Answer with the line {translated}, then one line for each text with the same number and its translation, then the line {terms}, "
        f"then one JSON object of names and terms that later texts should translate alike (or {{}}), then the line {end}.",
        "Leave a line out if its text must not be translated. Keep markup, placeholders, selectors, numbers and the signs for line ends as they are. "
        "A text that is a JSON or SNBT component must stay one: translate only what a player reads.",
    ]
    return "\n".join([*out, *_context(settings)])


def terms_prompt(settings: Settings) -> str:
    """Instructions for naming the terms of some texts."""
    out = [
        f"You prepare the translation of a game world from {settings.source} to {settings.target}.",
        "The message holds texts, one a line. Name people, places, items and other terms that have to be translated alike everywhere.",
        "Answer with one JSON object: each term as it stands in the texts, and its translation. Leave out everyday words.",
    ]
    return "\n".join([*out, *_context(settings)])


def _context(settings: Settings) -> list[str]:
    out = []
    if settings.about:
        out.append(f"About the world: {settings.about}")
    if settings.style:
        out.append(f"Style: {settings.style}")
    return out


def better_prompt(model: Model, prompt: str, retries: int = RETRIES) -> str:
    """A prompt as a model words it anew; blank answers don't count."""

    def read(answer: str) -> str:
        if not answer.strip():
            raise ValueError("a blank answer")
        return answer.strip()

    return chat(model, "Word these instructions more clearly, keep every rule and mark in them, and answer with nothing else:\n" + prompt, read, retries)


def prompted(model: Model, prompt: str) -> Model:
    """A model that is given the same instructions before every message."""
    return lambda text: model(prompt + "\n\n" + text)


def named(spec: str) -> Model:
    """The callable that ``module:name`` names."""
    module, mark, name = spec.partition(":")
    if not mark:
        raise ValueError("a model is given as module:name")
    return getattr(importlib.import_module(module), name)


class Progress:
    """Listeners by the class of what happens; those of a base class hear of it, too."""

    def __init__(self):
        self._listeners: dict[type, list[Callable]] = {}

    def on(self, kind: type, listener: Callable) -> Progress:
        self._listeners.setdefault(kind, []).append(listener)
        return self

    def tell(self, event: object) -> None:
        for kind in type(event).__mro__:
            for listener in self._listeners.get(kind, ()):
                listener(event)


@dataclass(frozen=True)
class Step:
    """So many of so many done."""

    done: int
    of: int


@dataclass(frozen=True)
class Used:
    """Tokens that a call has taken."""

    tokens: int


# The bits of the levels in a mask.
LEVELS = {"debug": 1, "info": 2, "warning": 4, "error": 8}
_NUMBERS = {logging.DEBUG: 1, logging.INFO: 2, logging.WARNING: 4, logging.ERROR: 8, logging.CRITICAL: 8}


def logger(name: str, *levels: str) -> logging.Logger:
    """A logger that lets through just the levels named, whatever their order."""
    mask = sum(LEVELS[x] for x in set(levels))
    out = logging.getLogger(name)
    out.setLevel(logging.DEBUG)
    out.filters = [lambda record: bool(_NUMBERS.get(record.levelno, 0) & mask)]
    return out
