"""Files that nobody wrote by hand: machine-made, minified or bundled, third-party, data as code.

Generation notices are found by one multi-pattern automaton over the first lines of a file and
count only where they stand in a comment, some only at its start: code about generated code
speaks of the same things further on in a sentence. Path rules cover what a name or a folder
says, the look of the first lines tells minified code and tables of literals, and a table of
content hashes tells known third-party files.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fold_key

#: Notices that count anywhere in a comment of the header.
NOTICES = (
    "do not edit this file", "do not edit manually", "do not edit by hand", "do not change by hand", "do not modify by hand",
    "do not modify this file", "do not edit. generated", "@generated", "<auto-generated", "<autogenerated", "this is a generated file",
    "this file is generated", "this file was generated", "this file is auto-generated", "this file is autogenerated",
    "this file has been generated", "this file was automatically generated", "this file is automatically generated",
    "this code was generated", "this class was generated", "produced by a tool", "manual changes are overwritten",
    "manual changes will be overwritten", "manual changes will be lost", "changes to this file will be lost",
    "changes to this file may cause incorrect behavior", "changes made to this file will be overwritten", "any changes will be overwritten",
    "generated by the protocol buffer compiler", "autogenerated by thrift", "generated by django", "generated by swagger", "generated by openapi",
    "lexical scanner generated by flex", "bison parser", "meta object code from reading",
)
#: Notices that count at the start of a comment only.
OPENINGS = (
    "code generated by", "generated by", "generated from", "generated with", "generated using", "generated code", "generated file", "generated automatically",
    "auto-generated", "autogenerated", "auto generated", "automatically generated", "machine-made", "machine made", "machine-generated",
    "machine generated", "created by a tool", "compiled by", "compiled from",
)
#: Folders of third-party copies; the second kind only before a package folder with a version.
VENDORED = "node_modules bower_components jspm_packages vendor third_party third-party thirdparty 3rdparty 3rd_party external externals godeps site-packages .bundle pods carthage".split()
VERSIONED = "deps dep contrib lib libs packages ext".split()
#: Folders of machine-made source, and of built output.
MACHINE_MADE = "generated __generated__ gen autogen auto-generated generated-sources gensrc".split()
BUILT = "dist out build target".split()
#: Names of machine-made, built and lock files.
MADE_NAME = re.compile(
    r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|c|rs|dart|swift)|\.pb\.gw\.go|_grpc\.pb\.go|_pb\.(js|ts|d\.ts|rb)|_grpc_pb\.(js|ts|d\.ts)|_pb_service\.js|outerclass\.java|grpc\.java"
    r"|[._-]generated\.[a-z]+|_generated_[a-z0-9_.]*|(^|_)zz_generated[a-z0-9_.]*|[._]gen\.[a-z]+|\.g\.(cs|dart|ts|i\.cs)|\.designer\.(cs|vb)|\.tab\.[ch]|\.yy\.[ch]|\.lex\.[ch]|_bindata\.go|_string\.go|\.freezed\.dart)$"
    r"|^(moc|ui|qrc|lex\.yy|y\.tab)[_.][a-z0-9_.]*\.(c|cc|cpp|h|py)$"
)
SMALL_NAME = re.compile(r"([._-]min|\.umd|\.bundle|[._-]bundle|\.chunk|\.prod(uction)?|\.packed?|-debug\.min)\.(m?js|cjs|css)$|\.[0-9a-f]{8,32}\.(m?js|cjs|css)$|^vendors?~")
LOCK_NAME = re.compile(r"^(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|flake\.lock|packages\.lock\.json|bun\.lockb?)$")
_PACKAGE, _RELEASE = re.compile(r"^@?[a-z][a-z0-9_.@-]*+$"), re.compile(r"[-_@]v?\d++\.\d[a-z0-9.-]*+$")
_COMMENT = re.compile(r"\s*(//+!?|#+!?|/\*+!?|\*+|--+|;+|%+|<!--|'|rem\b|\"\"\"|''')\s*")
#: Languages whose built output is minified, for files without a known suffix.
SCRIPTS = ("javascript", "css", "js")
#: Default of ``data_bytes``.
DATA_BYTES = 500_000

_KINDS = ("generated", "minified", "third_party", "data")


def notice_automaton() -> ahocorasick.Automaton:
    """All notices in one automaton; the value says whether it has to open the comment."""
    a = ahocorasick.Automaton()
    for x in NOTICES:
        a.add_word(x, (x, False))
    for x in OPENINGS:
        if x not in a:
            a.add_word(x, (x, True))
    a.make_automaton()
    return a


_LEAD = re.compile(r"[ \t*#\-/!<]*+")
_PAIRS = (("/*", "*/"), ("<!--", "-->"))


def _comment_starts(low: str) -> tuple[list[int], list[int]]:
    """Where each line starts and where the words of its comment do (-1 for no comment), in one pass."""
    starts, begins, inside, at = [], [], [False, False], 0
    for line in low.split("\n"):
        mark = _COMMENT.match(line)
        starts.append(at)
        begins.append(at + _LEAD.match(line, mark.end() if mark else 0).end() if mark or any(inside) else -1)
        for i, (start, end) in enumerate(_PAIRS):
            a, b = line.rfind(start), line.rfind(end)
            inside[i] = a > b if a != b else inside[i]
        at += len(line) + 1
    return starts, begins


def has_notice(head: str, automaton: ahocorasick.Automaton) -> bool:
    """Whether a comment in the first lines says that a tool made the file."""
    low, lines = head.lower(), None
    for end, (word, opening) in automaton.iter(low):
        starts, begins = lines = lines or _comment_starts(low)
        at = end - len(word) + 1
        begin = begins[bisect.bisect_right(starts, at) - 1]
        if begin >= 0 and (not opening or at <= begin or (at - begin < 16 and low[begin:at].strip() in ("this file", "this code", "file") and "do not edit" in low)):
            return True
    return False


#: A number or a quoted text. All quantifiers are possessive, so every pattern below takes linear time.
_NUMBER = r"[-+]?+(?>0x[0-9a-f]++|\d[\d._]*+(?:e[-+]?+\d++)?+[lfu]*+)"
_ONE = rf"""(?>"[^"\n]*+"|'[^'\n]*+'|{_NUMBER}|(?:null|none|nil|true|false)\b)"""
#: A line of literals only, with separators or white space between them.
_LITERAL = re.compile(rf"^\s*+[\[{{(]?+\s*+{_ONE}(?:(?:\s*+[,:;]\s*+|\s++){_ONE})*+\s*+[,:;]?+\s*+[\]}})]?+\s*+[,;]?+\s*+$", re.I)
#: Twelve numbers in a row, or a long run of encoded bytes.
_RUN = re.compile(rf"""(?<![\w.]){_NUMBER}\s*+,(?:\s*+{_NUMBER}\s*+,){{11}}|["'](?:[A-Za-z0-9+/=_-]{{100}}|(?:[0-9a-f]{{2}}){{60}})|(?:\\x[0-9a-f]{{2}}){{20}}""", re.I)


def looks_like_data(head: str) -> bool:
    """A long run of numbers or encoded bytes, or mostly lines of literals only."""
    if _RUN.search(head):
        return True
    lines = [x for x in head.split("\n") if x.strip()]
    rows = sum(bool(_LITERAL.match(x)) and bool(re.search(r"\d", x)) for x in lines[1:-1] if len(x.strip()) > 3)
    return rows >= 3 and rows >= 0.6 * (len(lines) - 2)


def looks_minified(head: str) -> bool:
    """Long lines of dense code with one-letter names and hardly any white space."""
    body = re.sub(r"^\s*/\*.*?\*/\s*", "", head, flags=re.S) if head.lstrip().startswith("/*") else head
    longest = max(body.split("\n"), key=len)
    if len(longest) < 120 or _COMMENT.match(longest):
        return False
    names = re.findall(r"[A-Za-z_$][\w$]*", longest)
    short = sum(len(x) == 1 for x in names)
    space = sum(c.isspace() for c in longest) / len(longest)
    return space < 0.12 and len(names) >= 8 and short >= 0.5 * len(names) and bool(re.search(r"[;,}]", longest))


def file_kind(path: str | None, size: int | None, head: str | None, automaton: ahocorasick.Automaton, language: str | None = None, data_bytes: int = DATA_BYTES) -> str | None:
    """The first kind that applies, or None for hand-written source.

    ``language`` is often wrong, so it only speaks for files whose name has no suffix.
    """
    parts = re.sub(r"/+", "/", (path or "").strip().replace("\\", "/").lower()).split("/")
    folders, name = [x for x in parts[:-1] if x not in ("", ".")], parts[-1]
    head = head or ""
    for i, folder in enumerate(folders):
        after = folders[i + 1] if i + 1 < len(folders) else ""
        if folder in VENDORED or (folder in VERSIONED and _PACKAGE.match(after) and _RELEASE.search(after)):
            return "third_party"
    if MADE_NAME.search(name) or LOCK_NAME.search(name) or any(x in MACHINE_MADE for x in folders) or (head and has_notice(head, automaton)):
        return "generated"
    script = re.search(r"\.(m?js|cjs|css)$", name) or ("." not in name and (language or "").strip().lower() in SCRIPTS)
    if SMALL_NAME.search(name) or (script and any(x in BUILT for x in folders)) or (head and looks_minified(head)):
        return "minified"
    if head and looks_like_data(head) or (not head.strip() and (size or 0) >= data_bytes):
        return "data"
    return None


def classify_files(files: DataFrame, third_party: DataFrame, *, data_bytes: int = DATA_BYTES) -> DataFrame:
    """``file_id`` and ``kind`` of files that are not hand-written, each pair once.

    ``files``: file_id, rel_path, byte_size, language, content_hash, head_text; ``third_party``:
    content_hash. A file of ``data_bytes`` bytes or more without first lines holds data. Kinds: generated, minified, third_party, data. A file delivered several times
    is judged by each delivery. Null or empty paths, sizes and first lines say nothing; a null
    file_id gives no row; blank hashes match nothing; letter case and surrounding white space
    of hashes and paths do not matter. Long first lines are read whole. Extra columns are
    ignored and empty tables give an empty result.
    """
    files = files.where(F.col("file_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = notice_automaton()
        for b in batches:
            kinds = [file_kind(p, s, h, automaton, x, data_bytes) for p, s, h, x in zip(*(b.column(c).to_pylist() for c in ("rel_path", "byte_size", "head_text", "language")))]
            out = pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(kinds, pa.string())], names=["file_id", "kind"])
            yield out.filter(pc.is_valid(out.column("kind")))

    by_look = files.select("file_id", "rel_path", F.col("byte_size").cast("bigint").alias("byte_size"), "head_text", "language").mapInArrow(run, "file_id string, kind string")
    known = third_party.select(fold_key(F.col("content_hash")).alias("h")).where("h <> ''").distinct()
    by_hash = files.select("file_id", fold_key(F.col("content_hash")).alias("h")).where("h <> ''").join(known, "h", "left_semi").select("file_id", F.lit("third_party").alias("kind"))
    return by_look.unionByName(by_hash).distinct()
