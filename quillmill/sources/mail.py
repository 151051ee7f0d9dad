"""Raw messages to mails: parsing, filters, deduplication, attachment texts and storage paths."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from contextlib import suppress
from datetime import timezone
from email.message import Message
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.names import fresh
from quillmill.functions.text import extension, py_strip, safe_component
from quillmill.sources.ranks import ranked

LARGEST = 50 * 1024 * 1024
#: Bytes of messages, and how many of them, that a task parses before it passes them on.
AT_ONCE, MOST_AT_ONCE = 2_000_000, 500
#: Headers that tell forwarded copies and bulk mail.
KEPT_HEADERS = ("x-forwarded-by", "x-forwarded-for", "list-id", "precedence")
NAMELESS = "unnamed_attachment"
MAIL = "message_id string, subject string, sender string, recipient string, received_at timestamp_ntz, body_text string, headers map<string, string>, attachments array<struct<filename: string, content: binary, content_type: string>>"


def read_raw_mail(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of message files up to 50 MB."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= LARGEST)


#: What is noted of a file that landed: its name below the folder, and its bytes.
NOTE = "name string, length long"


def _landing(messages: DataFrame, folder: str) -> DataFrame:
    """``NOTE`` rows of the files that tasks write: ``folder/place/<task>-<row>.txt`` for each row (place, content)."""

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, sizes = [], []
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files.create_dir(f"{root}/{place}", recursive=True)
                names.append(f"{place}/{task:05d}-{n:09d}.txt")
                sizes.append(len(content or b""))
                with files.open_output_stream(f"{root}/{names[-1]}") as out:
                    out.write(content or b"")
                n += 1
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "length": pa.array(sizes, pa.int64())})

    return messages.select("place", "content").mapInArrow(land, NOTE)


def land_messages(messages: DataFrame, folder: str) -> DataFrame:
    """A file for each row (place, content): ``folder/place/<task>-<row>.txt``; returns how many each task landed (column n), once it is run.

    Tasks write the files themselves, where a Spark writer makes, moves and marks each one several times. A task that is run
    again writes the same files again, if its rows come as before.
    """
    return _landing(messages, folder).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n")


def land_noted(messages: DataFrame, folder: str, notes: str) -> None:
    """Lands the files of ``land_messages`` and adds their ``NOTE`` rows to the table ``notes``, a file of them for each task, when all its files are there.

    ``polls.poll_noted`` streams what is noted, so that nobody lists the folder, however many files it has.
    """
    _landing(messages, folder).write.mode("append").parquet(notes)


def read_noted(noted: DataFrame, folder: str) -> DataFrame:
    """(path, content) of ``NOTE`` rows; tasks open the files by name and pass them on by ``AT_ONCE`` bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)

        def some(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
            paths, contents = zip(*found)
            return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})

        for batch in batches:
            found, size = [], 0
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as file:
                    found.append((f"{folder}/{name}", file.read()))
                size += len(found[-1][1])
                if size >= AT_ONCE or len(found) == MOST_AT_ONCE:
                    yield some(found)
                    found, size = [], 0
            if found:
                yield some(found)

    return noted.select("name").mapInArrow(read, "path string, content binary")


def discard_noted(noted: DataFrame, folder: str) -> None:
    """Removes the places of noted files from ``folder``, with all they hold, in tasks: for one that nothing reads any more.

    The driver would list and remove very many files one by one, and what it leaves for its end has 30 seconds there.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for place in batch.column(0).to_pylist():
                with suppress(FileNotFoundError):  # a task that is run again
                    files.delete_dir(f"{root}/{place}")
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    place = F.regexp_extract("name", "^(.+)/", 1).alias("place")
    dealt = noted.select(place).filter("place <> ''").repartition(int(noted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")
    dealt.distinct().mapInArrow(remove, "n long").agg(F.sum("n")).collect()  # one number


#: What is not text in a page: comments, tags, and tags around scripts and styles, whose content is text as it stands.
#: Runs are possessive: a group that may give back would need stack for each character of a long tag.
MARKUP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*+>(.*?)</\1\s*+>|<[a-z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
CUT, AS_IS = "\x01", "\x02"
ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescaped(c: Column) -> Column:
    """A text with the characters that HTML's entities stand for; those that it doesn't know stay."""
    named = {f"&{name}": value for name, value in html5.items() if name.endswith(";")}
    known = F.from_json(F.lit(json.dumps(named)), "map<string, string>")
    parts = F.split(c, f"(?={ENTITY})|(?<=;)")

    def said(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#(\d+);$", 1)
        number = F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.conv(F.nullif(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).cast("bigint"))
        one = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(x.startswith("&"), F.coalesce(one, F.try_element_at(known, x), x)).otherwise(x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, said), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible strings of a page, a line each; scripts are text, comments are none. A null page has no text."""
    marked = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), MARKUP, f"{CUT}{AS_IS}$2{CUT}"), CUT)
    lines = F.transform(marked, lambda x: py_strip(F.when(x.startswith(AS_IS), F.substring(x, 2, 1 << 30)).otherwise(unescaped(x))))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def decoded(value: object) -> str:
    """A header with its encoded words decoded; unknown charsets as UTF-8, and all as it stands if a word is broken."""
    out, said = [], str(value or "")
    try:
        parts = email.header.decode_header(said)
    except Exception:  # broken base64, among others
        return said
    for part, charset in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        try:
            out.append(part.decode(charset or "utf-8", "replace"))
        except (LookupError, ValueError):  # ValueError: a charset name that can't be one
            out.append(part.decode("utf-8", "replace"))
    return "".join(out)


def decode_header(c: Column) -> Column:
    """A header column decoded; null stays null."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(decoded, na_action="ignore")

    return convert(c)


def _payload(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def _is_attachment(part: Message) -> bool:
    return "attachment" in str(part.get("Content-Disposition") or "").lower()


def body_of(message: Message) -> tuple[str, bool]:
    """(text, it is a page): the first plain part that says something, else the first such page; a single body is plain."""
    if not message.is_multipart():
        return _payload(message).strip(), False
    parts = [p for p in message.walk() if not p.is_multipart() and not _is_attachment(p)]
    for kind in ("text/plain", "text/html"):
        for part in parts:
            if part.get_content_type() == kind and (text := _payload(part).strip()):
                return text, kind == "text/html"
    return "", False


def attachments_of(message: Message) -> list[dict[str, object]]:
    out = []
    for part in message.walk() if message.is_multipart() else ():
        name = part.get_filename()
        if not part.is_multipart() and (_is_attachment(part) or name) and (data := part.get_payload(decode=True)):
            out.append({"filename": decoded(name) if name else NAMELESS, "content": data, "content_type": part.get_content_type()})
    return out


def _date(message: Message, as_of: str) -> object:
    """When a message was sent, in UTC; ``as_of`` if it doesn't say so in a way that can be read."""
    try:
        when = email.utils.parsedate_to_datetime(str(message["Date"]))
        when = when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when
        return pd.Timestamp(when).to_pydatetime()
    except Exception:  # no date, or one out of range
        return pd.Timestamp(as_of).to_pydatetime()


def parse_or_reject(raw: DataFrame, as_of: str, largest: int = LARGEST) -> DataFrame:
    """(path, mail columns, error) of raw (path, content) rows; a message that can't be read only has path and error.

    A message without an id gets one from its content, one without a readable date the time ``as_of``.
    Null contents and those over ``largest`` bytes are rejected unread. Whatever one message raises
    is that message's error and ends no job.
    """
    columns = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|timestamp|map|array))", MAIL)]
    columns.insert(columns.index("body_text") + 1, "is_page")

    def parsed(path: str, synth: str, content: bytes) -> tuple[object, ...]:
        m = email.message_from_bytes(content)
        to = ", ".join(decoded(x) for h in ("To", "Cc") for x in m.get_all(h, []) if str(x).strip())
        recipient = to or decoded(m.get("Delivered-To")) or decoded(m.get("X-Original-To"))
        headers = {k: str(m[k]) for k in KEPT_HEADERS if m[k]}
        return (path, str(m["Message-ID"] or "").strip() or synth, decoded(m["Subject"]), decoded(m["From"]), recipient, _date(m, as_of), *body_of(m), headers, attachments_of(m), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for path, synth, content, why in zip(batch["path"], batch["synth"], batch["content"], batch["why"]):
                try:
                    rows.append((path, *[None] * len(columns), why) if why else parsed(path, synth, content))
                except Exception as error:  # of one message, which is rejected with it
                    rows.append((path, *[None] * len(columns), f"{type(error).__name__}: {error}"))
                size += len(content or b"")
                if size >= AT_ONCE or len(rows) == MOST_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["path", *columns, "error"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", *columns, "error"])

    size = F.octet_length("content")
    why = F.when(F.col("content").isNull(), "no content").when(size > largest, F.format_string(f"over {largest} bytes: %d", size))
    ready = raw.select("path", F.concat(F.lit("synth-"), F.sha2("content", 256)).alias("synth"), F.when(size <= largest, F.col("content")).alias("content"), why.alias("why"))
    found = ready.mapInPandas(run, f"path string, {MAIL.replace('body_text string', 'body_text string, is_page boolean')}, error string")
    return found.withColumn("body_text", F.when(F.col("is_page"), html_to_text(F.col("body_text"))).otherwise(F.col("body_text"))).drop("is_page")


def parse_mail(raw: DataFrame, as_of: str) -> DataFrame:
    """The messages of ``parse_or_reject`` that can be read."""
    return parse_or_reject(raw, as_of).filter("error is null").drop("error")


def rejects(parsed: DataFrame) -> DataFrame:
    """(path, error) of the messages of ``parse_or_reject`` that can't be read: for the reject table."""
    return parsed.filter("error is not null").select("path", "error")


def explode_attachments(mails: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mail_id, att_idx, filename, content, content_type), and columns of the mail to ``keep``, so that it needn't be parsed again for them."""
    return mails.select(F.col("message_id").alias("mail_id"), *keep, F.posexplode("attachments").alias("att_idx", "a")).select("mail_id", *keep, "att_idx", "a.*")


def filter_senders(mails: DataFrame, accounts: DataFrame, shared: list[str]) -> DataFrame:
    """Mails whose sender holds none of the account's or the shared entries; mails without an account only meet the shared ones."""
    clean = [x.strip().lower() for x in shared if x.strip()]
    entries = F.array_union(F.filter(F.transform(F.split(F.coalesce("filter_sender", F.lit("")), ","), lambda x: F.lower(py_strip(x))), lambda x: x != ""), F.array(*map(F.lit, clean)).cast("array<string>"))
    own_deny = fresh(mails, "deny")
    own = accounts.select(F.col("id").alias("account_id"), entries.alias(own_deny))
    joined = mails.join(own, "account_id", "left")
    deny = F.coalesce(own_deny, F.array(*map(F.lit, clean)).cast("array<string>"))
    sender = F.lower(F.coalesce("sender", F.lit("")))
    return joined.filter(~F.exists(deny, lambda x: F.contains(sender, x))).drop(own_deny)


#: Length of the grams by which entries of a long deny list are looked up.
GRAM = 4


def _grams(text: Column, lengths: list[int]) -> Column:
    """The distinct runs of these lengths in a text."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *map(of_length, lengths))))


def _held(senders: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows (keys, said) of ``senders`` that hold an entry of their keys, of distinct rows (keys, entry).

    An entry of up to ``GRAM`` characters is a gram itself, so that a semi-join finds it. A longer one is looked up by the
    gram of its own that the fewest senders of its keys have, and what meets is verified.
    """
    lengths = sorted(r.n for r in entries.select(F.least(F.length("entry"), F.lit(GRAM)).alias("n")).distinct().collect())  # of 1 to GRAM
    said = senders.select(*keys, "said", F.explode(_grams(F.col("said"), lengths)).alias("gram"))
    short, long = (entries.filter(x).select(*keys, "entry") for x in (F.length("entry") <= GRAM, F.length("entry") > GRAM))
    as_they_are = said.join(short.withColumnRenamed("entry", "gram"), [*keys, "gram"], "left_semi").select(*keys, "said")
    long_said = said.filter(F.length("gram") == GRAM)
    frequency = long_said.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    own = long.select(*keys, "entry", F.explode(_grams(F.col("entry"), [GRAM])).alias("gram"))
    rarest = own.join(frequency, [*keys, "gram"], "left").groupBy(*keys, "entry").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    verified = long_said.join(rarest, [*keys, "gram"]).filter(F.contains("said", F.col("entry"))).select(*keys, "said")
    return as_they_are.unionByName(verified).distinct()


def filter_senders_long(mails: DataFrame, accounts: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``filter_senders`` where the shared entries are a table (column entry) of any length.

    No list is pasted to mails. Distinct senders are cut into grams, by which entries find them in equi-joins: shared
    entries all senders, an account's entries only the senders of that account, however many accounts have the same entry.
    """
    low = F.lower(F.coalesce("sender", F.lit("")))
    clean = F.lower(py_strip(F.col("entry")))
    theirs = accounts.filter("id is not null").select(F.col("id").alias("account_id"), F.explode(F.split(F.coalesce("filter_sender", F.lit("")), ",")).alias("entry"))
    theirs, ours = (x.withColumn("entry", clean).filter("entry <> ''").distinct() for x in (theirs, shared.select("entry")))
    who, denied_account = fresh(mails, "who"), fresh(mails, "denied_account")
    senders = mails.select("account_id", low.alias("said")).distinct()
    by_account = _held(senders.join(theirs, "account_id", "left_semi"), theirs, ["account_id"])
    by_all = senders.join(_held(senders.select("said").distinct(), ours, []), "said").select("account_id", "said")
    denied = by_account.unionByName(by_all).select(F.col("account_id").alias(denied_account), F.col("said").alias(who)).distinct()
    return mails.join(denied, (low == F.col(who)) & F.col("account_id").eqNullSafe(F.col(denied_account)), "left_anti")


def within_lookback(mails: DataFrame, as_of: str, days: int = 7, column: str = "received_at") -> DataFrame:
    return mails.filter(F.to_date(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_forwarded_copies(mails: DataFrame, markers: list[str]) -> DataFrame:
    """Mails that this system did not send itself; encoded markers are decoded first."""
    raw = F.try_element_at("headers", F.lit("x-forwarded-by"))
    said = F.coalesce(decode_header(F.when(raw.contains("=?"), raw)), raw)  # Python only gets what is encoded
    return mails.filter(~F.coalesce(py_strip(said).isin(markers), F.lit(False)))


def dedup_batch(mails: DataFrame, order: list[str]) -> DataFrame:
    """The first mail of each message id; blank ids are no duplicates of each other."""
    keyed = F.coalesce(F.col("message_id") != "", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("message_id").orderBy(*order))
    n = fresh(mails, "n")
    return mails.filter(keyed).withColumn(n, rank).filter(F.col(n) == 1).drop(n).unionByName(mails.filter(~keyed))


def drop_known(mails: DataFrame, log: DataFrame) -> DataFrame:
    return mails.join(log.select("message_id").filter("message_id <> ''"), "message_id", "left_anti")


def with_preview(mails: DataFrame, n: int = 500) -> DataFrame:
    return mails.withColumn("preview", F.left("body_text", F.lit(n)))


def newest_per_account(mails: DataFrame, n: int = 200) -> DataFrame:
    order, place = Window.partitionBy("account_id").orderBy(F.desc("received_at"), "message_id"), fresh(mails, "place")
    return mails.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= n).drop(place)


def first_images(images: Column, most: int = 5) -> Column:
    """The images of one model request: the first of an array."""
    return F.slice(images, 1, most)


def docx_text(content: bytes | None) -> str:
    """Paragraphs that say something, a line each; empty for a broken file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except Exception:  # whatever is broken: the container, a member's compression, the document
        return ""
    lines = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
    return "\n".join(x for x in lines if x.strip())


#: How an old binary document begins.
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Characters that count as readable in such a document, and in any other old one.
OLE_READABLE = r"\u4e00-\u9fff\u3000-\u303f\uff00-\uffefa-zA-Z0-9\s.,;:!?()（）《》【】\-+=/%@#&*\"'"
READABLE = r"\u4e00-\u9fff\u3000-\u303f\uff00-\uffefa-zA-Z0-9\s.,;:!?()（）《》【】\-+=/\\@#$&*\"'"


def readable_runs(content: bytes | None) -> str:
    """Readable runs of an old document: of a binary one, as UTF-16, the first 500 lines of three characters or more; else of
    the bytes as UTF-8, the first 300 runs of four or more. The document's stream is not told from the rest of its container."""
    data = content or b""
    if data.startswith(OLE):
        lines = re.sub(f"[^{OLE_READABLE}]+", "\n", data.decode("utf-16-le", "replace")).split("\n")
        found = [x.strip() for x in lines if len(x.strip()) > 2][:500]
        if found:
            return "\n".join(found)
    return "\n".join(re.findall(f"[{READABLE}]{{4,}}", data.decode("utf-8", "replace"))[:300])


def extract_text(attachments: DataFrame, max_chars: int = 500_000) -> DataFrame:
    """``attachments`` with text instead of content, in one pass; formats that can't be read are empty."""

    @F.pandas_udf("string")
    def packed(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else docx_text(c) if k == "docx" else readable_runs(c) for c, k in zip(content, kind)], dtype="object")

    kind = extension(F.col("filename"))
    of_document = packed(F.when(kind.isin("docx", "doc", "wps"), F.col("content")), kind)  # Python gets no other contents
    plain = F.when(kind.isin("txt", "md", "csv", "log"), F.make_valid_utf8(F.col("content").cast("string")))
    text = F.left(py_strip(F.coalesce(plain, of_document, F.lit(""))), F.lit(max_chars))
    nothing = kind.isin("txt", "md", "csv", "log", "docx", "doc", "wps") & F.col("content").isNull()
    return attachments.withColumn("text", F.when(nothing, F.lit(None)).otherwise(text)).drop("content")


def dedupe_names(df: DataFrame, scope: list[str], name: str, order: list[str]) -> DataFrame:
    """The n-th equal name of a scope gets ``_n`` before its extension; the first keeps its name. A name may be that of very many rows."""
    place = fresh(df, "place")
    n = F.col(place) - 1
    cut = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    numbered = F.concat(cut, F.lit("_"), n.cast("string"), F.substring(F.col(name), F.length(cut) + 1, F.length(name)))
    return ranked(df, [*scope, name], order, place).withColumn(name, F.when(n == 0, F.col(name)).otherwise(numbered)).drop(place)


def storage_path(attachments: DataFrame, root: str = "attachments") -> DataFrame:
    """``attachments`` (account, received_at, filename, ...) with path: account, day, name without collisions."""
    account, day, name = (fresh(attachments, x) for x in ("safe_account", "day", "safe_name"))
    shown = F.coalesce(F.date_format("received_at", "yyyy-MM-dd"), F.lit("unknown"))
    shaped = attachments.withColumns({account: safe_component(F.col("account")), day: shown, name: safe_component(F.col("filename"))})
    named = dedupe_names(shaped, [account, day], name, ["mail_id", "att_idx"])
    return named.withColumn("path", F.concat_ws("/", F.lit(root), account, day, name)).drop(account, day, name)
