"""Archive attachments expanded into their members, within one budget per mail."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import ARCHIVES, PACKED_DOCUMENTS, archive_kind

DEPTH, FILES, FILE_BYTES, TOTAL_BYTES = 3, 100, 100 << 20, 200 << 20
TARS = ("tar.gz", "tar.bz2", "tar.xz", "tgz", "tbz2", "txz", "tar")
SINGLE = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}
MAGIC = ((b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"))


def kind_of(name: str, data: bytes) -> str | None:
    """An archive that can be opened here, by name, else by its first bytes."""
    low = name.lower()
    if low.endswith(tuple("." + s for s in PACKED_DOCUMENTS)):
        return None
    named = next((s for s in ARCHIVES if low.endswith("." + s)), None)
    kind = named or next((k for magic, k in MAGIC if data.startswith(magic)), None)
    if kind == "zip" and named is None:
        try:
            if "[Content_Types].xml" in zipfile.ZipFile(io.BytesIO(data)).namelist():
                return None
        except Exception:  # no archive after all
            return None
    return kind if kind in (*TARS, *SINGLE, "zip") else None


def base_name(path: str) -> str | None:
    """Last part of a member's path; null for absolute paths, drives and parent steps."""
    unix = path.replace("\\", "/")
    parts = unix.split("/")
    return None if unix.startswith("/") or unix[1:2] == ":" or ".." in parts else parts[-1] or None


def members(name: str, data: bytes, kind: str) -> Iterator[tuple[str, Callable[[int], bytes]]]:
    """Names and readers; a reader gives at most so many bytes, whatever the header says."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, lambda n, info=info: z.open(info).read(n)
    elif kind in TARS:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, lambda n, info=info: t.extractfile(info).read(n)
    else:
        inner = name[: -len(kind) - 1] if name.lower().endswith("." + kind) else name + ".out"
        yield inner, lambda n: SINGLE[kind](io.BytesIO(data)).read(n)


class Budget:
    def __init__(self, files: int, file_bytes: int, total_bytes: int) -> None:
        self.files, self.file_bytes, self.total = files, file_bytes, total_bytes


def expand(name: str, data: bytes, budget: Budget, depth: int, errors: list[str]) -> list[tuple[str, bytes]]:
    """Members that fit; nested archives are opened to the depth, beyond they stay packed."""
    out: list[tuple[str, bytes]] = []
    try:
        for path, read in members(name, data, kind_of(name, data) or "zip"):
            own = base_name(path)
            if own is None or budget.files <= 0:
                errors.append(f"{path}: {'unsafe name' if own is None else 'too many files'}")
                continue
            most = min(budget.file_bytes, budget.total)
            content = read(most + 1)
            if len(content) > most:
                errors.append(f"{path}: too large")
                continue
            if depth > 1 and kind_of(own, content):
                inner = expand(own, content, budget, depth - 1, errors)
                if inner:
                    out += inner
                    continue
            budget.files -= 1
            budget.total -= len(content)
            out.append((own, content))
    except Exception as error:  # whatever a broken archive raises is its error, and ends no job
        errors.append(f"{name}: {type(error).__name__}: {error}")
    return out


def expand_archives(attachments: DataFrame, max_depth: int = DEPTH, max_files: int = FILES, max_file: int = FILE_BYTES, max_total: int = TOTAL_BYTES) -> DataFrame:
    """(mail_id, att_idx, member, filename, content, expanded, errors); only mails with an archive are shuffled.

    The budget is shared by a mail's attachments in order. An archive that fails or has no
    member that fits stays as it is.
    """
    shaped = attachments.select("mail_id", "att_idx", "filename", "content")
    archive = archive_kind(F.col("filename"), F.col("content")).isNotNull()
    with_one = shaped.filter(archive).select("mail_id").distinct()
    plain = shaped.join(with_one, "mail_id", "left_anti").select("mail_id", "att_idx", F.lit(0).alias("member"), "filename", "content", F.lit(False).alias("expanded"), F.array().cast("array<string>").alias("errors"))

    def run(mail: pd.DataFrame) -> pd.DataFrame:
        budget, rows = Budget(max_files, max_file, max_total), []
        for r in mail.sort_values("att_idx").itertuples():
            errors: list[str] = []
            found = expand(r.filename, r.content, budget, max_depth, errors) if kind_of(r.filename or "", r.content or b"") else []
            rows += [(r.mail_id, r.att_idx, n, name, data, True, errors) for n, (name, data) in enumerate(found)] or [(r.mail_id, r.att_idx, 0, r.filename, r.content, False, errors)]
        return pd.DataFrame(rows, columns=["mail_id", "att_idx", "member", "filename", "content", "expanded", "errors"])

    kind = attachments.schema["mail_id"].dataType.simpleString()
    packed = shaped.join(with_one, "mail_id", "left_semi").groupBy("mail_id").applyInPandas(run, f"mail_id {kind}, att_idx int, member int, filename string, content binary, expanded boolean, errors array<string>")
    return plain.unionByName(packed)


def archive_stats(expanded: DataFrame) -> DataFrame:
    """(mail_id, expanded, extracted, errors)."""
    return expanded.groupBy("mail_id").agg(F.bool_or("expanded").alias("expanded"), F.count_if("expanded").alias("extracted"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
