"""Reading SCIP cross-reference files (protocol-buffer wire format), and making them.

The wire format is walked directly: an index holds documents (field 2) and
external symbols (3); a document its path (1), occurrences (2) and symbols (3).
"""

from __future__ import annotations

import shutil
import struct
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TOOL = "scip-python"
OCCURRENCES = (
    "relative_path string, doc_idx int, occ_idx int, symbol string, symbol_roles int, single_line struct<line int, start_character int, end_character int>,"
    " multi_line struct<start_line int, start_character int, end_line int, end_character int>, `range` array<int>"
)
RELATIONSHIPS = "relative_path string, sym_idx int, symbol string, target string, is_reference boolean, is_implementation boolean, is_type_definition boolean, is_definition boolean"
#: Field numbers of the format.
INDEX = {"documents": 2, "external_symbols": 3}
DOCUMENT = {"relative_path": 1, "occurrences": 2, "symbols": 3}
OCCURRENCE = {"range": 1, "symbol": 2, "symbol_roles": 3, "single_line_range": 8, "multi_line_range": 9}
SYMBOL = {"symbol": 1, "relationships": 4}
RELATIONSHIP = {"symbol": 1, "is_reference": 2, "is_implementation": 3, "is_type_definition": 4, "is_definition": 5}


class GenerationError(RuntimeError):
    """No cross-reference file could be made."""


def tool_available() -> bool:
    return shutil.which(TOOL) is not None


def generate(root: str | Path, output: str | Path, project: str | None = None, timeout: float = 600.0) -> Path:
    """Run the indexer over ``root``; whatever goes wrong is a GenerationError."""
    tool, out = shutil.which(TOOL), Path(output).resolve()
    if tool is None:
        raise GenerationError(f"{TOOL} is not on PATH")
    out.parent.mkdir(parents=True, exist_ok=True)
    try:
        subprocess.run(
            [tool, "index", "--project-name", project or Path(root).name, "--output", str(out), "--cwd", str(root)],
            check=True,
            capture_output=True,
            text=True,
            timeout=timeout,
        )
    except subprocess.TimeoutExpired as e:
        raise GenerationError(f"{TOOL} took more than {timeout:.0f} s") from e
    except (subprocess.CalledProcessError, OSError) as e:
        raise GenerationError(f"{TOOL} failed: {getattr(e, 'stderr', None) or e}") from e
    if not out.is_file():
        raise GenerationError(f"{TOOL} made no {out}")
    return out


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of a message: numbers as they are, the rest as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("damaged message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            (value,) = struct.unpack_from("<q" if kind == 1 else "<i", data, at)
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def _int32(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _ints(data: memoryview, names: list[str]) -> dict[str, int]:
    """A message of int32 fields, numbered from 1 in this order; missing ones are 0."""
    out = dict.fromkeys(names, 0)
    for number, value in fields(data):
        if number <= len(names):
            out[names[number - 1]] = _int32(value)
    return out


def _occurrence(data: memoryview) -> dict:
    out: dict = {"symbol": "", "symbol_roles": 0, "single_line": None, "multi_line": None, "range": []}
    for number, value in fields(data):
        if number == OCCURRENCE["range"]:
            if isinstance(value, int):
                out["range"].append(_int32(value))
            else:
                at = 0
                while at < len(value):
                    one, at = _varint(value, at)
                    out["range"].append(_int32(one))
        elif number == OCCURRENCE["symbol"]:
            out["symbol"] = bytes(value).decode()
        elif number == OCCURRENCE["symbol_roles"]:
            out["symbol_roles"] = _int32(value)
        elif number == OCCURRENCE["single_line_range"]:
            out["single_line"] = _ints(value, ["line", "start_character", "end_character"])
        elif number == OCCURRENCE["multi_line_range"]:
            out["multi_line"] = _ints(value, ["start_line", "start_character", "end_line", "end_character"])
    return out


def _relationships(data: memoryview) -> tuple[str, list[dict]]:
    symbol, out = "", []
    for number, value in fields(data):
        if number == SYMBOL["symbol"]:
            symbol = bytes(value).decode()
        elif number == SYMBOL["relationships"]:
            one = {"target": "", "is_reference": False, "is_implementation": False, "is_type_definition": False, "is_definition": False}
            names = {n: k for k, n in RELATIONSHIP.items()}
            for inner, v in fields(value):
                name = names.get(inner)
                if name == "symbol":
                    one["target"] = bytes(v).decode()
                elif name:
                    one[name] = bool(v)
            out.append(one)
    return symbol, out


#: What stands for a symbol that has no relationships.
NO_RELATIONSHIP = {"target": None, "is_reference": False, "is_implementation": False, "is_type_definition": False, "is_definition": False}


def decode_document(data: bytes, doc_idx: int) -> tuple[str, list[dict], list[dict]]:
    """Path, occurrence rows and relationship rows of one document message."""
    path, occurrences, relations = "", [], []
    symbols = 0
    for number, value in fields(memoryview(data)):
        if number == DOCUMENT["relative_path"]:
            path = bytes(value).decode()
        elif number == DOCUMENT["occurrences"]:
            occurrences.append({**_occurrence(value), "doc_idx": doc_idx, "occ_idx": len(occurrences)})
        elif number == DOCUMENT["symbols"]:
            symbol, found = _relationships(value)
            relations += [{**r, "symbol": symbol, "sym_idx": symbols} for r in found or [NO_RELATIONSHIP]]
            symbols += 1
    return path, [{**o, "relative_path": path} for o in occurrences], [{**r, "relative_path": path} for r in relations]


def decode_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, relationships) of document messages (doc_idx, data), decoded by executors."""

    def rows(which: int, schema: str):
        names = [f.split()[0].strip("`") for f in _split(schema)]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [r for i, data in frame.itertuples(index=False) for r in decode_document(bytes(data), i)[which]]
                yield pd.DataFrame([[r[n] for n in names] for r in out], columns=names)

        return raw.select("doc_idx", "data").mapInPandas(run, schema)

    return rows(1, OCCURRENCES), rows(2, RELATIONSHIPS)


def read(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(occurrences, relationships) of a file.  The driver cuts it into documents; executors decode them."""
    documents, external = [], []
    for number, value in fields(memoryview(Path(path).read_bytes())):
        if number == INDEX["documents"]:
            documents.append((len(documents), bytearray(value)))
        elif number == INDEX["external_symbols"]:
            symbol, found = _relationships(value)
            external += [{**r, "symbol": symbol, "sym_idx": len(external), "relative_path": None} for r in found or [NO_RELATIONSHIP]]
    occurrences, relationships = decode_documents(spark.createDataFrame(documents, "doc_idx int, data binary"))
    names = [f.split()[0] for f in _split(RELATIONSHIPS)]
    outside = spark.createDataFrame([tuple(r[n] for n in names) for r in external], RELATIONSHIPS)
    return occurrences, relationships.unionByName(outside)


def _split(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return out
