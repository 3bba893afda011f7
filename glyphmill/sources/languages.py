"""Language files of a game version, by its public manifests: fetched through a callable, checked by SHA-1."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

# The game's public addresses, and where its language files stand in an asset index.
MANIFEST = "https://piston-meta.mojang.com/mc/game/version_manifest_v2.json"
RESOURCES = "https://resources.download.minecraft.net"
FOLDER = "minecraft/lang/"

Fetch = Callable[[str], bytes]


class DownloadError(ValueError):
    pass


def fetch(url: str) -> bytes:
    """What an address gives."""
    from urllib.request import urlopen

    with urlopen(url, timeout=3600) as answer:  # noqa: S310
        return answer.read()


def _checked(get: Fetch, url: str, digest: str | None) -> bytes:
    raw = get(url)
    if digest is not None and hashlib.sha1(raw).hexdigest() != digest:  # noqa: S324  the publisher's choice
        raise DownloadError(f"{url} isn't what its digest says")
    return raw


def language_files(version: str = "latest", languages: list[str] | None = None, get: Fetch = fetch) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, texts by key) of a version's languages, all or those named; ``latest`` is the latest release."""
    manifest = json.loads(get(MANIFEST))
    wanted = manifest["latest"]["release"] if version == "latest" else version
    entry = next((v for v in manifest["versions"] if v["id"] == wanted), None)
    if entry is None:
        raise DownloadError(f"no version {wanted}")
    index = json.loads(_checked(get, entry["url"], entry.get("sha1")))["assetIndex"]
    objects = json.loads(_checked(get, index["url"], index.get("sha1")))["objects"]
    for path, at in sorted(objects.items()):
        name = path.removeprefix(FOLDER).rsplit(".", 1)[0]
        if path.startswith(FOLDER) and (languages is None or name in languages):
            yield name, json.loads(_checked(get, f"{RESOURCES}/{at['hash'][:2]}/{at['hash']}", at["hash"]))
