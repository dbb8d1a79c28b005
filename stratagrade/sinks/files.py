"""Single files written whole or not at all, alone or in bundles, and scalable folders of
JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import messages as say
from ..sources.places import Place, scratch_folder


def refuse_existing(paths: list, overwrite: bool) -> None:
    existing = [str(p) for p in map(Place, paths) if p.exists()]
    if existing and not overwrite:
        raise FileExistsError(say.OUTPUT_EXISTS.format(paths=", ".join(existing)))


class Bundle:
    """Files that are all written beside their places before the first is put there.

    Used in a with statement: an error inside leaves every place as it was.
    """

    def __init__(self) -> None:
        self.staged: list[tuple[Place, Place]] = []

    def add(self, path, chunks: Iterable[str]) -> None:
        place = Place(path)
        self.staged.append((place.beside(), place))
        self.staged[-1][0].write(chunks)

    def add_lines(self, path, lines: DataFrame, between: str, head: str = "", tail: str = "", empty: str = "") -> None:
        """A file of the texts in the one column of `lines`, in their order: tasks write parts
        of it, which are then put together byte by byte.  `between` also ends the last text
        unless there is a `tail`; without any text the file is `empty`."""
        place = Place(path)
        self.staged.append((place.beside(), place))
        stage = _stage(place)
        try:
            lines.write.options(lineSep=between, compression="none").text(stage.uri)
            parts = [p for p in stage.files() if p.name.startswith("part-") and p.size()]
            if parts:
                self.staged[-1][0].write_joined(head, parts, tail, len(between.encode()) if tail else 0)
            else:
                self.staged[-1][0].write([empty])
        finally:
            stage.delete()

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            while kind is None and self.staged:
                temporary, place = self.staged[0]
                temporary.replace(place)
                self.staged.pop(0)
        finally:
            for temporary, _ in self.staged:
                temporary.delete()


def _stage(place: Place) -> Place:
    """A folder for tasks' parts of a file: where executors share one, else beside the file."""
    try:
        return scratch_folder("parts")
    except ValueError:
        return place.beside()


def _write(path, chunks: Iterable[str], bundle: Bundle | None) -> None:
    if bundle is not None:
        bundle.add(path, chunks)
        return
    with Bundle() as alone:
        alone.add(path, chunks)


def _write_lines(path, lines: DataFrame, bundle: Bundle | None, **ends: str) -> None:
    if bundle is not None:
        bundle.add_lines(path, lines, **ends)
        return
    with Bundle() as alone:
        alone.add_lines(path, lines, **ends)


def texts(df: DataFrame, form: Callable[[dict], str]) -> DataFrame:
    """value: each row's text, made by tasks."""

    def made(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                yield pa.record_batch([pa.array([form(row) for row in b.slice(i, 500).to_pylist()], pa.string())], names=["value"])

    return df.mapInArrow(made, "value string")


def _item(item, indent: int) -> str:
    body = item if isinstance(item, str) else json.dumps(item, ensure_ascii=False, indent=indent)
    return "\n".join(" " * indent + line for line in body.split("\n"))


def _array(items: Iterable, indent: int) -> Iterable[str]:
    first = True
    for item in items:
        yield ("[\n" if first else ",\n") + _item(item, indent)
        first = False
    yield "[]\n" if first else "\n]\n"


def write_json_array(rows, path, indent: int = 2, bundle: Bundle | None = None, of: Callable[[dict], dict] | None = None) -> None:
    """A DataFrame (written by tasks, in its order; `of` makes the object of a row) or any
    iterable as one JSON array."""
    if isinstance(rows, DataFrame):
        _write_lines(path, texts(rows, lambda row: _item(of(row) if of else row, indent)), bundle, between=",\n", head="[\n", tail="\n]\n", empty="[]\n")
    else:
        _write(path, _array(rows, indent), bundle)


def write_json(data, path, indent: int = 2, newline: bool = True, bundle: Bundle | None = None) -> None:
    _write(path, [json.dumps(data, ensure_ascii=False, indent=indent) + "\n" * newline], bundle)


def write_json_object(entries: Iterable[tuple[str, object]], path, indent: int = 4) -> int:
    """Keys, each once, and their values as one JSON object, entry by entry; returns how many
    there are.  There is no line feed at the end."""
    n = 0

    def chunks():
        nonlocal n
        for key, value in entries:
            body = json.dumps({key: value}, ensure_ascii=False, indent=indent)
            yield ("{" if n == 0 else ",") + body[1:-2]
            n += 1
        yield "\n}" if n else "{}"

    _write(path, chunks(), None)
    return n


def write_jsonl(rows, path, bundle: Bundle | None = None) -> None:
    line = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if isinstance(rows, DataFrame):
        _write_lines(path, texts(rows, line), bundle, between="\n")
    else:
        _write(path, (line(x) + "\n" for x in rows), bundle)


def write_split_folders(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The scalable form: JSON lines in a folder for each split."""
    df.write.mode(mode).partitionBy("split").json(path)
