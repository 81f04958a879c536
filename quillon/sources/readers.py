"""Readers of libraries: Markdown with front matter, folders, JSON papers, SQLite and layout files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from quillon.functions.text import stable_id
from quillon.sources.sqlite import sqlite_table  # noqa: F401
from quillon.storage import arrow_file_system, cut, file_system

MOST_BYTES, MOST_DEPTH = 5 << 20, 32
SKIPPED = (".git", "node_modules", ".obsidian", ".trash")
KINDS = (".md", ".txt", ".html", ".htm", ".pdf", ".docx", ".json")

ROW = "path string, content_hash string, id string, is_question boolean, title string, stem string, options array<struct<key:string,text:string>>, answer array<string>, explanation string, subject string, category string, difficulty int, year int, tags array<string>, body string"

# Names under which a field may stand, in order.
ALIASES = {
    "stem": ("stem", "question", "题干"),
    "answer": ("answer", "answers", "correct", "答案"),
    "explanation": ("explanation", "analysis", "解析"),
    "options": ("options", "choices", "选项"),
    "subject": ("subject", "科目"),
    "category": ("category", "module", "分类"),
    "tags": ("tags", "keywords", "标签"),
    "title": ("title", "name", "标题"),
}
_OPTION = re.compile(r"^\s*(?:[-*]\s*)?([A-HＡ-Ｈ])\s*[.、．:：)]\s*(.+)$", re.M)


_ENTRY = "path string, name string, folder boolean, link boolean"
_HIDDEN = re.compile(r"(?!_common_metadata|_metadata)(?:_[^=]*\Z|\.|.*\._COPYING_\Z)", re.S)


def _inside(folder: str) -> Iterator[tuple[str, bool, bool]]:
    """What is in a folder: name, whether it is a folder, whether it is a symbolic link; broken links are left out."""
    system, place = arrow_file_system(folder)
    if system.type_name != "local":
        from pyarrow import fs

        for found in system.get_file_info(fs.FileSelector(place)):
            yield found.base_name, found.type == fs.FileType.Directory, False
        return
    with os.scandir(place) as entries:
        for e in entries:
            if not e.is_symlink():
                yield e.name, e.is_dir(), False
            elif os.path.exists(e.path):
                inside = os.path.realpath(place).startswith(os.path.realpath(e.path).rstrip("/") + "/") or os.path.realpath(place) == os.path.realpath(e.path)
                if not inside:  # a link to a folder that it is in would be followed for ever
                    yield e.name, e.is_dir(), True


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([("path", pa.string()), ("name", pa.string()), ("folder", pa.bool_()), ("link", pa.bool_())])
    for batch in batches:
        for path, linked in zip(batch.column("path").to_pylist(), batch.column("link").to_pylist()):
            held: list[tuple] = []
            for name, folder, link in _inside(path):
                if not _HIDDEN.match(name):
                    held.append((f"{path.rstrip('/')}/{name}", name, folder, linked or link))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)


def paths(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Files of a folder tree by name: path and link, whether it is a symbolic link or in one. Hidden files are left out.

    Tasks list the folders, a level of the tree at a time, and each level is a written table: no list of files goes to the
    driver. ``folder`` may be a pattern; FileNotFoundError if there is none.
    """
    fs, target = file_system(spark, folder)
    roots = fs.globStatus(target)
    if not roots:
        raise FileNotFoundError(folder)
    level = spark.createDataFrame([(r.getPath().toString(), r.getPath().getName(), r.isDirectory(), False) for r in roots], _ENTRY)
    levels = [level.filter("not folder")]
    while not level.filter("folder").isEmpty():
        given = level.filter("folder").select("path", "link").repartition(spark.sparkContext.defaultParallelism, "path")
        level = cut(given.mapInArrow(_entries, _ENTRY), "listing")
        levels.append(level.filter("not folder"))
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.filter(F.col("name").rlike(f"(?s)^(?:{wanted})\\z")).select("path", "link")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [arrow_file_system(p) for p in batch.column("path").to_pylist()]
        # Files of one listing are in one file system.
        infos = at[0][0].get_file_info([place for _, place in at])
        if gone := [i.path for i in infos if not i.is_file]:
            raise FileNotFoundError(gone[0])
        length, modified = pa.array([i.size for i in infos], pa.int64()), pa.array([i.mtime_ns // 1_000_000 * 1_000 for i in infos], pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("link"), length, modified], names=["path", "link", "length", "modified"])


@F.udf(BinaryType(), useArrow=False)
def _content(path: str | None) -> bytes | None:
    # Not an Arrow function: one gives as many contents at once as a batch has rows.
    if path is None:
        return None
    system, place = arrow_file_system(path)
    if system.type_name == "local":
        with open(place, "rb") as f:
            return f.read()
    with system.open_input_stream(place) as f:
        return f.read()


def _spread(found: DataFrame, per_task: int) -> DataFrame:
    """Paths in tasks of about ``per_task``, whatever folders they are in."""
    return found.repartition(-(-found.count() // per_task) or 1, "path")


def with_content(found: DataFrame, per_task: int = 5_000) -> DataFrame:
    """(path) to path and content, read by tasks."""
    return _spread(found, per_task).select("path", _content("path").alias("content"))


def listed(spark: SparkSession, folder: str, pattern: str = "*.md", most_bytes: int | None = MOST_BYTES, most_depth: int | None = MOST_DEPTH, per_task: int = 5_000) -> DataFrame:
    """Files of a folder tree with ``left_out``: why one isn't read (ignored, size, depth), null if it is. None: no limit.

    Content is null for files that are left out. Symbolic links are followed nowhere by Hadoop's remote file systems; on a
    local one they are left out (link). Tasks list, look at and read about ``per_task`` files each.
    """
    raw = _spread(paths(spark, folder, pattern), per_task).mapInArrow(_facts, "path string, link boolean, length long, modified timestamp")
    parts = F.split("path", "/")
    depth = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")) - len([x for x in folder.split("://")[-1].split("/") if x])
    reason = F.when(F.exists(parts, lambda p: p.isin(*SKIPPED)), "ignored")
    if most_depth is not None:
        reason = reason.when(depth > most_depth, "depth")
    if most_bytes is not None:
        reason = reason.when(F.col("length") > most_bytes, "size")
    reason = reason.when(F.col("link"), "link")
    marked = raw.withColumn("left_out", reason)
    return marked.select("path", "length", "modified", _content(F.when(F.col("left_out").isNull(), F.col("path"))).alias("content"), "left_out")


def files(spark: SparkSession, folder: str, pattern: str = "*.md", most_bytes: int | None = MOST_BYTES, most_depth: int | None = MOST_DEPTH, per_task: int = 5_000) -> DataFrame:
    """Files of a folder tree: path, length, modified, content. Ignored folders, symbolic links, too deep and too large files
    are left out; ``listed`` says which."""
    return listed(spark, folder, pattern, most_bytes, most_depth, per_task).filter("left_out is null").drop("left_out")


def eligible(listing: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Adds id, eligible and reason to a listing (path, length, modified)."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~kind.isin(*KINDS), "kind").when(F.col("length") == 0, "empty").when(F.col("length") > most, "size")
    return listing.withColumn("id", stable_id(F.col("path"), F.col("length").cast("string"), F.col("modified").cast("string"))).withColumn("reason", reason).withColumn("eligible", reason.isNull())


def front_matter(text: str) -> tuple[dict, str]:
    """Front matter (scalars, inline lists and JSON, block lists) and the body. Damaged lines are skipped."""
    import json

    if not text.startswith("---\n") or "\n---" not in text[4:]:
        return {}, text
    head, _, body = text[4:].partition("\n---")
    out: dict = {}
    last = None
    for line in head.split("\n"):
        if m := re.match(r"\s*-\s+(.*)", line):
            if last is not None:
                out[last] = [*(out[last] if isinstance(out[last], list) else []), m[1].strip().strip("\"'")]
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            continue
        last, value = key.strip(), value.strip()
        try:
            out[last] = json.loads(value)
        except ValueError:
            inside = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else None
            out[last] = [v.strip().strip("\"'") for v in inside if v.strip()] if inside is not None else value.strip("\"'")
    return out, body.lstrip("\n")


def sections(body: str) -> dict[str, str]:
    """Text under each heading of the second level or deeper."""
    found = re.split(r"^#{2,6}\s+(.+?)\s*$", body, flags=re.M)
    return {found[i]: found[i + 1].strip() for i in range(1, len(found) - 1, 2)}


def first_title(body: str) -> str:
    m = re.search(r"^#\s+(.+?)\s*$", body, re.M)
    return m[1] if m else ""


def before_sections(body: str) -> str:
    return re.split(r"^#{2,6}\s+", re.sub(r"^#\s+.*$", "", body, count=1, flags=re.M), maxsplit=1, flags=re.M)[0].strip()


def options_of(value: object, body: str) -> list[dict]:
    """Options from a list of texts or objects, else from lettered lines of the body, letters of either width."""
    out = []
    if isinstance(value, dict):
        value = [{"key": k, "text": v} for k, v in sorted(value.items())]
    if isinstance(value, list) and value:
        for i, v in enumerate(value):
            key, text = (str(v.get("key", chr(65 + i))), v.get("text", "")) if isinstance(v, dict) else (chr(65 + i), re.sub(r"^[A-H]\s*[.、．:：]\s*", "", str(v)))
            out.append({"key": key.upper(), "text": str(text).strip()})
    else:
        out = [{"key": chr(ord(k) - 0xFEE0) if ord(k) > 0xFF00 else k, "text": t.strip()} for k, t in _OPTION.findall(body)]
    return [o for o in out if o["text"]]


def parsed_file(path: str, text: str) -> dict:
    """One Markdown file as a question or a document. A declared kind decides; else an answer with a stem or options."""
    import hashlib

    data, body = front_matter(text)
    parts = sections(body)
    get = lambda name, default="": next((data[a] for a in ALIASES[name] if data.get(a) not in (None, "", [])), next((parts[a] for a in ALIASES[name] if parts.get(a)), default))
    listed = lambda v: [str(x).strip() for x in v] if isinstance(v, list) else [x.strip() for x in re.split(r"[,，;；\n]", str(v)) if x.strip()]
    answer = get("answer")
    letters = re.fullmatch(r"[A-H]{2,8}", str(answer)) if not isinstance(answer, list) else None
    answers = list(str(answer)) if letters else listed(answer)
    options = options_of(get("options", []), before_sections(body) + "\n" + parts.get("选项", ""))
    stem = str(get("stem")) or (before_sections(_OPTION.sub("", body)) if options else "")
    declared = str(data.get("kind", data.get("type", ""))).lower()
    question = declared in ("question", "essay", "single", "multiple") or (declared not in ("document", "note") and bool(answers) and bool(stem or options))
    level = str(data.get("difficulty", ""))
    year = str(data.get("year", ""))
    return {
        "path": path,
        "content_hash": hashlib.sha256(text.encode()).hexdigest(),
        "id": str(data.get("id") or hashlib.sha256(path.encode()).hexdigest()[:24]),
        "is_question": question,
        "title": str(get("title")) or first_title(body) or path.rsplit("/", 1)[-1],
        "stem": stem,
        "options": options,
        "answer": answers,
        "explanation": str(get("explanation")),
        "subject": str(get("subject")),
        "category": str(get("category")),
        "difficulty": min(5, max(1, int(level))) if level.lstrip("-").isdigit() else 2,
        "year": int(year) if re.fullmatch(r"(?:19|20|21)[0-9]{2}", year) else None,
        "tags": list(dict.fromkeys(listed(get("tags")))),
        "body": body,
    }


def parse_markdown(contents: DataFrame) -> DataFrame:
    """(path, content as binary or text) to rows of questions and documents. Undecodable bytes are replaced."""
    types = to_arrow_schema(StructType.fromDDL(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A file has its text twice and its fields, so few files are rows at once.
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [parsed_file(p, c if isinstance(c, str) else bytes(c or b"").decode("utf-8", "replace")) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in types], schema=types)

    return contents.select("path", "content").mapInArrow(run, ROW)


def json_papers(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each question of each paper file; files that aren't such JSON are skipped."""
    schema = "title string, year int, questions array<struct<id:string,stem:string,options:map<string,string>,answer:string,category:string,material:string>>, _bad string"
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    good = raw.filter("_bad is null").select(F.col("title").alias("paper"), "year", F.posexplode("questions").alias("place", "q"))
    return good.select("paper", "year", (F.col("place") + 1).alias("place"), "q.*")


def taxonomy(tree: DataFrame) -> DataFrame:
    """(json) of modules, groups and topics, each with code and name, to code and "module-group-topic"."""
    leaf = "struct<code:string,name:string>"
    schema = f"array<struct<name:string,groups:array<struct<name:string,topics:array<{leaf}>>>>>"
    m = tree.select(F.explode(F.from_json("json", schema)).alias("m"))
    g = m.select("m.name", F.explode("m.groups").alias("g"))
    t = g.select(F.col("name"), F.col("g.name").alias("group"), F.explode("g.topics").alias("t"))
    return t.select("t.code", F.concat_ws("-", "name", "group", "t.name").alias("path"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Layout regions from JSON lines: doc, page, region_no, type, bbox, img_path, text."""
    return spark.read.schema("doc long, page int, region_no int, type string, bbox array<double>, img_path string, text string").json(path)


def worker_events(lines: DataFrame, states: tuple[str, ...] = ("running", "done", "failed")) -> DataFrame:
    """(line) of a worker's JSON progress: state of a fixed list, pages held to 0..total, confidence to 0..1; rest dropped."""
    e = F.from_json("line", "struct<state:string,page:int,total:int,confidence:double>")
    rows = lines.select(e.alias("e")).select("e.*").filter(F.col("state").isin(*states))
    total = F.greatest(F.coalesce("total", F.lit(0)), F.lit(0))
    return rows.select("state", F.greatest(F.lit(0), F.least(F.coalesce("page", F.lit(0)), total)).alias("page"), total.alias("total"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"))


def blocks(pages: DataFrame, kinds: Column | None = None) -> DataFrame:
    """(doc, page, blocks array of type, bbox, text, path) of a layout engine to regions in block order."""
    b = pages.select("doc", "page", F.posexplode("blocks").alias("region_no", "b"))
    return b.select("doc", "page", "region_no", F.when(F.col("b.type").isin("image", "figure", "chart"), "image").when(F.col("b.type") == "table", "table").otherwise("text").alias("type"), F.col("b.bbox").alias("bbox"), F.coalesce("b.path", F.lit("")).alias("img_path"), F.coalesce("b.text", F.lit("")).alias("text"))
