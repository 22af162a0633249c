"""Source files that do not parse.

Every file is split into tokens and recognised by a generalised LL parser, by all dialects of its path's extension; a
file that every dialect rejects is flagged. Dialects differ in the words that may be names, so only files that hold such
a word are run through more than one.

Defined results: null content is no case; empty content and content of blanks and comments only is valid; line ends of
any kind end a line; paths with another extension are no case; repeated rows count
once (the latest loaded_at).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import grammars, lexers
from graphloom.llm.gll import Grammar
from graphloom.llm.tables import raw_files
from graphloom.tables import latest

#: extension: (lexer, grammar text, start, dialects as extra words for sets)
LANGUAGES = {
    "rs": (lexers.rust, grammars.RUST, "File", [{}, {"@id": ["async", "await", "dyn", "try"]}]),
    "go": (lexers.go, grammars.GO, "File", [{}]),
    "ts": (lexers.ts, grammars.TS.replace("%casts ;", grammars.TS_CASTS + " ;").replace("'<cast>'", ""), "File", [{}, {"@id": ["await", "yield"]}]),
    "tsx": (lexers.tsx, grammars.TS.replace("%casts ;", grammars.TSX_ELEMENTS + " ;").replace("'<cast>'", ""), "File", [{}, {"@id": ["await", "yield"]}]),
    "py": (lexers.python, grammars.PYTHON, "File", [{}]),
}


@lru_cache
def dialects(ext: str) -> list[Grammar]:
    _, text, start, extra = LANGUAGES[ext]
    not_first = grammars.TS_NOT_FIRST if ext in ("ts", "tsx") else None
    return [Grammar(text, start, x, not_first) for x in extra]


def rejected(ext: str, text: str) -> bool:
    """True if no dialect of the extension accepts the text as one whole file."""
    if not text.strip():
        return False
    lex = LANGUAGES[ext][0]
    grams = dialects(ext)
    try:
        tokens = lex(text, grams[0])
    except lexers.LexError:
        return True
    if grams[0].recognise(tokens) < 0:
        return False
    for g, extra in zip(grams[1:], LANGUAGES[ext][3][1:], strict=True):
        words = {w for more in extra.values() for w in more}
        if any(re.search(rf"\b{w}\b", text) for w in words) and g.recognise(lex(text, g)) < 0:
            return False
    return True


#: Verdicts on texts that a task keeps, by their digests: repeated deliveries and equal contents are parsed once.
_KEPT = 100_000


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, bytes], bool] = {}
    for b in batches:
        bad = []
        for e, t in zip(b.column("ext").to_pylist(), b.column("content").to_pylist(), strict=True):
            if t is None:
                bad.append(None)
                continue
            key = (e, blake2b(t.encode(), digest_size=16).digest())
            if key not in known:
                if len(known) >= _KEPT:
                    known.clear()
                known[key] = rejected(e, t)
            bad.append(known[key])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file_id", "project_id", "path", "ext", "loaded_at")), pa.array(bad, pa.bool_())], names=["file_id", "project_id", "path", "ext", "loaded_at", "bad"])


def parsed_files(source_files: DataFrame) -> DataFrame:
    """file_id, project_id, path, ext, bad of every counting file with content and a supported extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)\s*$", 1))
    f = raw_files(source_files).select("file_id", "project_id", "path", ext.alias("ext"), F.when(ext.isin(*LANGUAGES), F.col("content")).alias("content"), "loaded_at")
    judged = f.mapInArrow(_flag, "file_id long, project_id string, path string, ext string, loaded_at timestamp, bad boolean")
    return latest(judged, ["file_id"]).filter(F.col("bad").isNotNull()).drop("loaded_at")


def unparsable(source_files: DataFrame) -> DataFrame:
    return parsed_files(source_files).filter("bad").select("file_id")


def parse_rates(source_files: DataFrame, units: DataFrame) -> DataFrame:
    """project_id, language (of the extension), n_files, n_bad, over the files named in units."""
    named = units.select("project_id", F.explode("source_files").alias("path")).filter("path is not null").distinct()
    p = parsed_files(source_files).join(named, ["project_id", "path"], "left_semi")
    language = F.element_at(F.create_map(*[F.lit(x) for x in ("rs", "rust", "go", "go", "ts", "typescript", "tsx", "typescript", "py", "python")]), F.col("ext"))
    return p.groupBy("project_id", language.alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("bad").alias("n_bad"))
