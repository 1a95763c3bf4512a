"""Source files that do not parse in the language their name claims.

Each text is cut into chunks, and each chunk is made a lexer-state map with a
bracket summary. The maps are reduced across partitions: within blocks of
adjacent chunks, then over the blocks of a file, which gives every chunk its
true start. Groups of balanced statements are parsed by the language's grammar
where a chunk holds them whole, and put together from their chunks where not.
A file that isn't closed, or of which a group fails, is confirmed as a whole
before it is flagged, so maps and cuts never decide.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import replace
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.functions.jsonstream import parsed
from factmill.io import materialize, table
from factmill.llm import js_grammar, lexer_maps, php_grammar

BLOCK = 64  # chunks that are reduced together before a file's blocks are
LANGUAGES = ("php", "json", "js", "xml", "py")
_MAPS = {"php": lexer_maps.PHP, "json": lexer_maps.JSON, "js": lexer_maps.JS, "xml": lexer_maps.XML, "py": lexer_maps.PYTHON}


def _accepted(check, *args) -> bool:
    try:
        check(*args)
    except (php_grammar.BadSyntax, js_grammar.BadSyntax):
        return False
    return True


def php_parses(text: str) -> bool:
    return php_grammar.has_tag(text) and _accepted(php_grammar.check, text)


def js_parses(text: str) -> bool:
    return _accepted(js_grammar.check, text)


def json_parses(text: str) -> bool:
    return parsed(text)[0]


def xml_parses(text: str) -> bool:
    try:
        expat.ParserCreate("utf-8").Parse(text.encode("utf-8"), True)  # whatever encoding it declares, this is text
    except (expat.ExpatError, ValueError):
        return False
    return True


def python_parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<text>", "exec", 0x400, dont_inherit=True)  # only to the syntax tree
    except (SyntaxError, ValueError, OverflowError):
        return False
    return True


_PARSES = {"php": php_parses, "json": json_parses, "js": js_parses, "xml": xml_parses, "py": python_parses}


def parses(language: str, text: str) -> bool | None:
    """Whether a text is valid in a language; None where nesting is too deep to tell."""
    try:
        return _PARSES[language](text)
    except (RecursionError, MemoryError):
        return _deep(language, text)


def _deep(language: str, text: str) -> bool | None:
    """Once more on a thread with a large stack."""
    import sys
    import threading

    found: list[bool | None] = [None]

    def run() -> None:
        try:
            found[0] = _PARSES[language](text)
        except (RecursionError, MemoryError):
            pass

    limit, size = sys.getrecursionlimit(), threading.stack_size()
    try:
        sys.setrecursionlimit(200_000)
        threading.stack_size(512 << 20)
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    return found[0]


def language_of(path_column: str):
    """The extension of a path in lower case, where it is one of the known languages; else null."""
    ext = F.lower(F.regexp_extract(path_column, r"\.([^./\\]+)\s*\z", 1))
    return F.when(ext.isin(*LANGUAGES), ext)


def piece_parses(language: str, part: str, first: bool, last: bool, root: str | None) -> bool:
    """Whether one group of balanced statements is valid by the language's local grammar.

    The groups of JSON and XML are members of the outermost container, whose
    bracket or tag is ``root``; it is put around them.
    """
    try:
        if language == "php":
            return _accepted(php_grammar.check, part, not first)
        if first and last or language in ("js", "py"):
            return _PARSES[language](part)
        if language == "xml":
            return xml_parses(("" if first else f"<{root}>") + part + ("" if last else f"</{root}>"))
        part = part.rstrip(" \t\r\n")
        if not last:
            if not part.endswith(","):
                return False
            part = part[:-1] + {"{": "}", "[": "]"}[root]
        found, value = parsed(part if first else root + part)
        return found and bool(value)  # an empty container would hide a comma too many
    except (RecursionError, MemoryError, KeyError):
        return False  # the whole file tells


VERDICT = "file_id bigint, project_id string, language string, valid boolean"
_FILE = "file_id bigint, project_id string, language string, version bigint"
_CHUNK = f"{_FILE}, n bigint, pos bigint, block bigint, text string, map string"
_PIECE = f"{_FILE}, ok boolean, head bigint, pos bigint, part string, first boolean, last boolean, root string"
_KEY = ["file_id", "version"]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _verdicts(rows: DataFrame) -> DataFrame:
    """Each text parsed as a whole where it lies."""

    def run(batches):
        for pdf in batches:
            valid = [None if t is None else parses(lang, t) for lang, t in zip(pdf["language"], pdf["text"])]
            yield pd.DataFrame({"file_id": pdf["file_id"], "project_id": pdf["project_id"], "language": pdf["language"], "valid": pd.array(valid, "boolean")})

    return rows.mapInPandas(run, VERDICT)


def chunk_rows(rows: DataFrame, size: int = lexer_maps.CHUNK_CHARS) -> DataFrame:
    """A row per chunk of every text with its map; a PHP text without a tag is marked broken."""

    def run(batches):
        for pdf in batches:
            out = []
            for f, p, lang, v, t in zip(*(pdf[c] for c in (*_names(_FILE), "text"))):
                parts = lexer_maps.text_maps(_MAPS[lang], t, size)
                if lang == "php" and not php_grammar.has_tag(t):
                    m = parts[0][1]
                    parts[0] = parts[0][0], {s: (replace(r, broken=True), c) for s, (r, c) in m.items()}
                out += [(f, p, lang, v, len(parts), i, i // BLOCK, part, lexer_maps.dump(m)) for i, (part, m) in enumerate(parts)]
            yield pd.DataFrame(out, columns=_names(_CHUNK))

    return rows.mapInPandas(run, _CHUNK)


def _tasks(rows: DataFrame) -> int:
    """Partitions of a shuffle before a Python stage: so few bytes are so much work that Spark must not join them by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _grouped(batches, keys: list[str], order: str, columns: list[str]):
    """(key, rows) of sorted batches, equal places once; a key's rows may lie in several batches."""
    key, rows, last = None, [], None
    for pdf in batches:
        for k, at, *row in zip(zip(*(pdf[c].tolist() for c in keys)), pdf[order].tolist(), *(pdf[c].tolist() for c in columns)):
            if k != key:
                if rows:
                    yield key, rows
                key, rows, last = k, [], None
            if at != last:  # rows that repeat
                rows.append((at, *row))
                last = at
    if rows:
        yield key, rows


def _scanned(rows: DataFrame, keys: list[str], order: str, columns: list[str], schema: str, of_group) -> DataFrame:
    """``of_group(key, rows)`` of the rows that agree in ``keys``, which meet in one task, in order."""

    def run(batches):
        out = []
        for key, group in _grouped(batches, keys, order, columns):
            out += [(*key, *r) for r in of_group(key, group)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=_names(schema))
                out = []
        yield pd.DataFrame(out, columns=_names(schema))

    return rows.select(*keys, order, *columns).repartition(_tasks(rows), *keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """(file_id, version, pos, head, cuts, closed, root): where each chunk is cut, and at which chunk the group begins that it goes on with.

    Maps are combined in blocks, the blocks' maps along each file, and the runs
    that lead to the blocks along their chunks.
    """
    block = [*_KEY, "language", "block"]

    def combined(key, rows):
        total = None
        for _, m in rows:
            runs = {s: r for s, (r, _) in lexer_maps.load(m).items()}
            total = runs if total is None else lexer_maps.combine(total, runs)
        yield (json.dumps({s: r.plain() for s, r in total.items()}),)

    def along(key, rows):
        language = _MAPS[key[2]]
        run, before = lexer_maps.Run(language.start), []
        for n, m in rows:
            before.append((n, json.dumps(run.plain())))
            run = run.then(lexer_maps.Run.read(json.loads(m)[run.end]))
        for n, r in before:
            yield n, r, lexer_maps.closed(language, run), run.root

    def inside(key, rows):
        language, run = _MAPS[key[2]], None
        for pos, m, before, ok, root in rows:
            run = lexer_maps.Run.read(json.loads(before)) if run is None else run
            here, cuts = lexer_maps.load(m)[run.end]
            yield pos, lexer_maps.effective(language, run, cuts) if ok else [], ok, root
            run = run.then(here)

    blocks = _scanned(chunks, block, "pos", ["map"], "file_id bigint, version bigint, language string, block bigint, map string", combined)
    lead = _scanned(blocks, [*_KEY, "language"], "block", ["map"], "file_id bigint, version bigint, language string, block bigint, before string, closed boolean, root string", along)
    starts = _scanned(
        chunks.select(*block, "pos", "map").join(lead, block), block, "pos", ["map", "before", "closed", "root"],
        "file_id bigint, version bigint, language string, block bigint, pos bigint, cuts array<bigint>, closed boolean, root string", inside,
    )
    before = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head = F.coalesce(F.last(F.when(F.size("cuts") > 0, F.col("pos")), ignorenulls=True).over(before), F.lit(0))
    return starts.select(*_KEY, "pos", head.alias("head"), "cuts", "closed", "root")


def _pieces(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Groups of statements: those that lie in one chunk with their verdict, of the others the parts."""

    def run(batches):
        for pdf in batches:
            out = []
            columns = (*_names(_FILE), "n", "pos", "text", "head", "cuts", "root")
            for f, p, lang, v, n, pos, t, head, cuts, root in zip(*(pdf[c].tolist() for c in columns)):
                bounds = [0, *map(int, cuts), len(t)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    first, last = pos == 0 and i == 0, pos == n - 1 and i == len(bounds) - 2
                    if (i or first) and (i < len(bounds) - 2 or last):
                        out.append((f, p, lang, v, piece_parses(lang, t[a:b], first, last, root), None, None, None, None, None, None))
                    else:
                        out.append((f, p, lang, v, None, pos if i else head, pos, t[a:b], first, last, root))
            made = pd.DataFrame(out, columns=_names(_PIECE))
            yield made.astype({"head": "Int64", "pos": "Int64", "ok": "boolean", "first": "boolean", "last": "boolean"})

    at = [*_KEY, "pos"]
    closed = starts.where("closed").drop("closed").repartition(_tasks(chunks), *at)
    return chunks.drop("map", "block").repartition(_tasks(chunks), *at).join(closed, at).mapInPandas(run, _PIECE)


def _joined(parts: DataFrame) -> DataFrame:
    """Groups that go over chunks, put together and parsed."""

    def run(batches):
        for pdf in batches:
            ok = [piece_parses(*x) for x in zip(*(pdf[c].tolist() for c in ("language", "part", "first", "last", "root")))]
            yield pdf[_names(_FILE)].assign(ok=ok)

    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "part"))), lambda x: x["part"]), "")
    whole = parts.repartition(_tasks(parts), *_names(_FILE), "head").groupBy(*_names(_FILE), "head").agg(text.alias("part"), F.max("first").alias("first"), F.max("last").alias("last"), F.max("root").alias("root"))
    return whole.mapInPandas(run, f"{_FILE}, ok boolean")


def checked_files(files: DataFrame, size: int = lexer_maps.CHUNK_CHARS) -> DataFrame:
    """(file_id, project_id, language, valid): each file once.

    ``valid`` is null for null texts and for texts nested too deep to tell; files
    of other extensions, without path or without id are left out. Of rows that repeat a
    file_id with other content, a file is invalid if any of its texts is.
    ``size`` is the length of the chunks.
    """
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), "project_id", language_of("relative_path").alias("language"), F.col("source_text").alias("text"))
    rows = rows.where(F.col("language").isNotNull() & F.col("file_id").isNotNull()).withColumn("version", F.xxhash64("text", "project_id", "language"))
    chunks = materialize(chunk_rows(rows.where(F.col("text").isNotNull()), size), "chunks")
    pieces = materialize(_pieces(chunks, chunk_starts(chunks)), "pieces")
    told = pieces.where("part is null").select(*_names(_FILE), "ok").unionByName(_joined(pieces.where("part is not null")))
    valid = materialize(told.groupBy(*_names(_FILE)).agg(F.min("ok").alias("valid")).where("valid"), "valid")
    open_files = chunks.where("pos = 0").select(*_KEY).distinct().join(valid, _KEY, "left_anti")
    again = _verdicts(rows.join(open_files, _KEY, "left_semi"))
    null = rows.where(F.col("text").isNull()).select("file_id", "project_id", "language", F.lit(None).cast("boolean").alias("valid"))
    every = valid.select(*_names(VERDICT)).unionByName(again).unionByName(null)
    return every.groupBy("file_id", "project_id", "language").agg(F.min("valid").alias("valid"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_files(table(spark, sf_dir, "source_files")).where(~F.col("valid")).select("file_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, language, files, unparsed, rate): files with text, those that don't parse, and their share."""
    files = checked_files(table(spark, sf_dir, "source_files")).where(F.col("valid").isNotNull())
    bad = F.count_if(~F.col("valid"))
    return files.groupBy("project_id", "language").agg(F.count("*").alias("files"), bad.alias("unparsed"), (bad / F.count("*")).alias("rate"))
