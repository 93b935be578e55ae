"""Finding artifacts and the text files beside them. Walks run on the driver: they list names, not contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from weightscope import constants as K
from weightscope.operators import rollup


def files(root: str) -> Iterator[str]:
    """Paths of files under ``root``, links followed, each real folder entered once; unreadable folders are passed over."""
    seen, stack = set(), [root]
    while stack:
        folder = stack.pop()
        real = os.path.realpath(folder)
        if real in seen:
            continue
        seen.add(real)
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            continue
        for name in names:
            path = os.path.join(folder, name)
            if os.path.isdir(path):
                stack.append(path)
            elif os.path.isfile(path):
                yield path


def _ext(path: str) -> str:
    return os.path.splitext(path)[1][1:].lower()


def artifacts(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """artifact, canonical, aliases: one row for each real file, of a folder or of those that ``only`` names. A file is taken as it is, whatever its name."""
    found = only if only is not None else [path] if os.path.isfile(path) else sorted(p for p in files(path) if _ext(p) in K.EXTENSIONS)
    rows = spark.createDataFrame([(p, os.path.realpath(p)) for p in found], "path string, canonical string")
    return rollup.aliases(rows)


def base_of(path: str) -> str:
    """The folder that repository checks start from: the path, or for all else its parent."""
    return path if os.path.isdir(path) else os.path.dirname(path) or "."


def _once(paths: list[str]) -> list[str]:
    """Sorted, of neighbours that are one real file the first."""
    out: list[str] = []
    for p in sorted(paths):
        if not out or os.path.realpath(out[-1]) != os.path.realpath(p):
            out.append(p)
    return out


def repository(path: str) -> tuple[list[str], list[str]]:
    """Python files and configuration files under a path's base."""
    found = list(files(base_of(path)))
    return _once([p for p in found if _ext(p) == "py"]), _once([p for p in found if os.path.basename(p).lower() in K.CONFIG_FILES])


def read_text(path: str, most: int | None = K.MAX_TEXT, lossy: bool = False) -> str | None:
    """A text file's content; None if it is missing, too long, or (unless ``lossy``) not UTF-8."""
    try:
        if not os.path.isfile(path) or (most is not None and os.path.getsize(path) > most):
            return None
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace" if lossy else "strict")
    except (OSError, UnicodeDecodeError):
        return None


def sidecar(artifact: str) -> str | None:
    """The first signature file that stands beside an artifact."""
    places = [artifact + e for e in (".sig", ".sigstore", ".bundle", ".manifest.json")]
    return next((p for p in [*places, os.path.join(os.path.dirname(artifact), "model.sig")] if os.path.exists(p)), None)


def resolve_model(path: str) -> str:
    """The file that stands for a model; ValueError if none or several do."""
    if not os.path.isdir(path):
        return path
    names = sorted(n for n in os.listdir(path) if os.path.isfile(os.path.join(path, n)))
    if "model.safetensors" in names:
        return os.path.join(path, "model.safetensors")
    for ext in ("safetensors", "gguf"):
        found = [n for n in names if _ext(n) == ext]
        if len(found) == 1:
            return os.path.join(path, found[0])
        if found:
            raise ValueError(f"{path} holds several {ext} files; name one")
    raise ValueError(f"{path} holds no safetensors or GGUF file")
