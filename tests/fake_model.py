"""A model for tests: answers in capitals, names words in capitals as terms, and fails where it's told to."""

from glyphmill.operators import translation

FAIL_AT: list[str] = []


def upper(prompt: str):
    _, _, body = prompt.rpartition(translation.START + "\n")
    if any(f in body for f in FAIL_AT):
        raise PermissionError("told to fail")
    lines = "\n".join(x.upper() for x in body.split("\n"))
    yield f"{translation.TRANSLATED}\n{lines}\n"
    yield f"{translation.TERMS}\n{{}}\n{translation.END}"


def terms(prompt: str) -> str:
    words = [w for w in prompt.split("\n\n")[-1].split() if w.istitle()]
    return "{" + ",".join(f'"{w}":"{w.upper()}"' for w in sorted(set(words))) + "}"
