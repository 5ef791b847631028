"""Sinks: Markdown files by policy, reports, bundles whose manifest comes last.

Names are given out in one place, by a window over the results; tasks then write each file beside its target and rename
it. What was written comes back as a table (source, path, outcome), so a run can be looked at or undone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import names, text
from foliant.operators import manifest

POLICIES = ("unique", "fail", "overwrite")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1)  # one store, two names
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _taken(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def free_path(fs: pafs.FileSystem, path: str, policy: str) -> str:
    """Where a file may go: the path itself, or with -1, -2 ... behind its stem."""
    if policy == "overwrite" or not _taken(fs, path):
        return path
    if policy == "fail":
        raise FileExistsError(path)
    stem, dot, suffix = path.rpartition(".")
    n = 1
    while _taken(fs, f"{stem}-{n}{dot}{suffix}"):
        n += 1
    return f"{stem}-{n}{dot}{suffix}"


def write_atomically(fs: pafs.FileSystem, path: str, parts: Iterable[bytes]) -> None:
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(beside, path)


def publish(rows: DataFrame, folder: str, policy: str = "unique") -> DataFrame:
    """rows (source, file, markdown; chunks, an array, if there is one) as files: the text and, as one unit, its chunks
    beside it as <stem>.part001.md ... A unit that can't be written whole is taken back."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy}; one of {POLICIES}")
    parts = F.col("chunks") if "chunks" in rows.columns else F.array().cast("array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for source, file, text, chunks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                done: list[str] = []
                try:
                    target = free_path(fs, f"{base}/{file}", policy)
                    stem = target.rpartition(".")[0]
                    for path, body in [(target, text), *((f"{stem}.part{n:03d}.md", c) for n, c in enumerate(chunks or [], 1))]:
                        write_atomically(fs, path, [(body or "").encode()])
                        done.append(path)
                    out.append((source, target, "written"))
                except (OSError, FileExistsError) as e:
                    for path in done if policy != "overwrite" else []:
                        fs.delete_file(path)
                    out.append((source, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["source", "path", "outcome"])

    return rows.select("source", "file", "markdown", parts.alias("chunks")).mapInArrow(run, "source string, path string, outcome string")


def write_report(results: DataFrame, path: str) -> None:
    """The report: a file that ends in .json is one array, by source and a partition of rows at a time; else a folder of
    JSON lines."""
    report = manifest.report(results)
    if not path.endswith(".json"):
        report.write.mode("overwrite").json(path)
        return
    rows = report.select("source", F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("__json")).orderBy("source")

    def parts() -> Iterator[bytes]:
        mark = "[\n"
        for row in rows.toLocalIterator():
            yield f"{mark}  {row[1]}".encode()
            mark = ",\n"
        yield b"[]\n" if mark == "[\n" else b"\n]\n"

    write_atomically(*opened(path), parts())


def as_text(markdown: Column) -> Column:
    """Markdown as plain text: no marks of headings, emphasis, lists and links; tables with tabs, fences without marks."""
    out = F.regexp_replace(markdown, r"(?m)^[ \t]*(?:```|~~~)[^\n]*\n?", "")
    out = F.regexp_replace(out, r"(?m)^\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*(?:\n|\z)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^#{1,6}[ \t]+|^[ \t]*[-*+][ \t]+|^>[ \t]?", ""), r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(\*{1,3})(?=\S)([^*\n]+?)(?<=\S)\1", "$2"), r"`([^`\n]+)`", "$1")
    cells = F.regexp_replace(F.regexp_replace(out, r"(?m)^\|[ \t]*|[ \t]*(?<!\\)\|[ \t]*$", ""), r"(?m)[ \t]+(?<!\\)\|[ \t]+", "\t")
    return F.regexp_replace(F.replace(cells, F.lit("\\|"), F.lit("|")), r"<br>", " ")


def write_bundle(results: DataFrame, folder: str, order: str, producer: str = "foliant", version: str = "0.1", target: str = "", include_warnings: bool = False, created_at: Column | None = None) -> str:
    """Documents, then the manifest, which so marks the bundle as whole. A folder that has a manifest is refused."""
    fs, base = opened(folder)
    if _taken(fs, f"{base}/manifest.json"):
        raise FileExistsError(f"{folder} has a manifest")
    kept = manifest.deliverable(results, include_warnings)
    docs = manifest.documents(kept, order)
    files = docs.select(F.col(order).alias("__o"), "file").join(kept, F.col("__o") == F.col(order)).select("source", "file", "markdown")
    bad = publish(files, folder, "fail").filter("outcome <> 'written'").first()
    if bad:
        raise OSError(f"{bad.source}: {bad.outcome}")
    lines = manifest.manifest_lines(docs, order, producer, version, target, created_at)
    write_atomically(fs, f"{base}/manifest.json", (line.encode() for line in lines))
    return f"{folder}/manifest.json"


def drop(results: DataFrame, inbox: str, order: str, tries: int = 8, **more) -> str:
    """A bundle in a new folder of an inbox."""
    for _ in range(tries):
        try:
            return write_bundle(results, f"{inbox}/bundle-{uuid.uuid4().hex[:12]}", order, **more)
        except FileExistsError:
            continue
    raise FileExistsError(f"no free folder in {inbox}")


def joined_text(results: DataFrame, order: str) -> DataFrame:
    """One row: all texts in order, parted by rules."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "markdown"))), lambda x: text.strip(x["markdown"]))
    return results.agg(F.array_join(texts, "\n\n---\n\n").alias("text"))


def named(results: DataFrame, order: str) -> DataFrame:
    """results with the file that each goes to."""
    stems = results.withColumn("__stem", names.safe_stem(names.stem_of(F.col("source"))))
    return names.unique_names(stems, "__stem", order).drop("__stem")
