import random
import re
import string

from glyphmill.llm import licenses
from glyphmill.llm.queries import QUERIES


def test_band_settings_meet_their_bound():
    for j in (0.2, 0.33, 0.5, 0.8):
        rows, bands = licenses.settings(j)
        assert (1 - j**rows) ** bands <= licenses.MISS


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for x in re.findall(r"[^\x20\x09-\x0D]+", lower) if (w := x.strip(string.punctuation))]


def brute(text, scanner):
    """Every template against every window of its length class, on tuples of words."""
    words, found = plain_words(text), []
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for level in scanner.levels:
        for i in {x for v in level.index.values() for x in v}:
            body = plain_words(licenses.TEMPLATES[scanner.names[i]])
            own, spans = {tuple(body[k : k + 5]) for k in range(len(body) - 4)}, []
            for s in range(0, len(shingles), level.stride):
                hits = [k for k in range(s, min(len(shingles), s + level.window)) if shingles[k] in own]
                held = len({shingles[k] for k in hits})
                if 5 * held >= 4 * len(own):
                    if spans and hits[0] < spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], hits[-1] + 5), max(held, spans[-1][2]), spans[-1][3] | set(hits))
                    else:
                        spans.append((hits[0], hits[-1] + 5, held, set(hits)))
            found += [(s, e, i, held, at) for s, e, held, at in spans]
    return sorted((s, e, scanner.names[i]) for s, e, i, held, at in found if not any(o > held and 2 * len(at & b) >= len(at) for *_, o, b in found))


def test_found_where_contained(spark):
    """Against containment of all templates in all windows by other code, and against what was planted."""
    r = random.Random(1)
    names = sorted(licenses.TEMPLATES)
    rows, planted = [], {}
    for i in range(300):
        words = [r.choice(["alpha", "beta,", "gamma", "-", "under", "license", "the"]) for _ in range(r.randint(310, 500))]
        planted[i] = r.sample(names, r.randint(0, 2))
        for k, name in enumerate(planted[i]):
            body = licenses.TEMPLATES[name].split()
            if len(body) > 60:
                body[r.randrange(len(body))] = "changed"
            whole = ["--", *body, "--"] if r.random() < 0.5 else [w.upper() for w in body]
            words = words + whole if k else whole + words  # one at each end, so that no window holds two
        rows.append((i, " ".join(words), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (None, (licenses.TEMPLATES["MIT"] + " ") * 300, "x"), (902, "... !!!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    scanner, matches, missed = licenses.Scanner(licenses.TEMPLATES), 0, 0
    for i, text, _ in rows[:300]:
        expected = {f"{n}:{s}:{e}" for s, e, n in brute(text, scanner)}
        own = set(filter(None, found[i].spans.split(",")))
        matches, missed = matches + len(expected), missed + len(expected ^ own)
        assert set(planted[i]) <= set(found[i].licenses.split(","))
    assert matches > 250 and missed <= 1
    assert found[900].n_matches == found[901].n_matches == found[902].n_matches == 0 and found[None].licenses == "MIT"
    assert licenses.license_scan(docs.limit(0)).collect() == []


def test_licenses_of_a_family_are_told_apart():
    import numpy as np

    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"):
        data, offsets = licenses.text_bytes(licenses.pa.array(["one two three four five " + licenses.TEMPLATES[name]]))
        matches = scanner.matches(licenses._shingles(data, np.asarray(offsets))[0])
        assert [scanner.names[i] for i, _, _ in matches] == [name]


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, sf).collect()}
    assert len(rows) == len(texts)
    lines = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-notice")}
    for i, text in texts.items():
        expected = {n for n, t in lines.items() if re.search(r"(?<!\S)" + re.escape(t) + r"(?!\S)", text)}
        assert set(filter(None, rows[i].licenses.split(","))) == expected
