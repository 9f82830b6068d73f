"""Text, token, identifier, path and hash functions as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters, digits, ``_``, ``.`` and ``-``; null and empty text has none."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_\s.-]", " "), r"\s+"), lambda x: x != "")


def token_estimate(c: Column) -> Column:
    """Structural characters count one token each, others a token for 3.5."""
    t = F.coalesce(c, F.lit(""))
    prose = F.length(F.translate(t, '{}[]:,"', ""))
    return F.ceil(F.length(t) - prose + prose / F.lit(3.5).cast("double"))


def coarse_estimate(c: Column) -> Column:
    """A token for four characters."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)


def packed_estimate(c: Column) -> Column:
    """A token for 3.2 characters."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(3.2).cast("double"))


def card_estimate(name: Column, signature: Column, summary: Column, out: Column) -> Column:
    """Tokens of a symbol's card: 50, a quarter of its texts (150 of the summary at most), 5 a dependency."""
    size = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    return 50 + size(name) + size(signature) + F.least(size(summary), F.lit(150)) + 5 * out


def subwords(c: Column) -> Column:
    """Lower-case parts of an identifier by case, digits and punctuation, of two letters or more."""
    s = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, r"([a-zA-Z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([a-zA-Z])", "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters."""
    return F.array_distinct(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))).otherwise(F.array().cast("array<string>")))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all of both, 0 if either text is shorter than three."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.length(a) >= 3) & (F.length(b) >= 3) & (both > 0), F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def glob_pattern(c: Column) -> Column:
    """A glob as a regular expression: ``*`` is any text, ``?`` any letter, all else itself."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", ".")


def relevance(name: Column, query: Column, name_parts: Column | None = None, query_parts: Column | None = None) -> Column:
    """How well a name answers a query, without letter case.

    Equal 1; a glob that is all of the name .9 or part of it .75; a name that starts with the
    query .85 or contains it .7; a query that starts with the name .65; all parts of the query
    .8 or of the name .7, some of them by share and trigrams; some of several words .3 to .6; a
    name within the query .5; else by trigrams and shared parts. Over many rows the ``subwords``
    of both should be columns of their own, since they are looked at again and again.
    """
    n, q = F.lower(name), F.lower(query)
    np, qp = subwords(name) if name_parts is None else name_parts, subwords(query) if query_parts is None else query_parts
    hit_q = F.size(F.filter(qp, lambda x: F.exists(np, lambda y: F.contains(y, x) | F.contains(x, y))))
    hit_n = F.size(F.filter(np, lambda x: F.exists(qp, lambda y: F.contains(y, x) | F.contains(x, y))))
    many = (F.size(qp) >= 2) & (F.size(np) >= 2)
    tri = trigram_similarity(n, q)
    best = F.greatest(hit_q / F.size(qp), hit_n / F.size(np))
    words = F.filter(F.split(q, r"[\s_]+"), lambda x: F.length(x) >= 3)
    said = F.size(F.filter(words, lambda x: F.contains(n, x)))
    long = F.filter(np, lambda x: F.length(x) >= 3)
    some = F.size(F.filter(long, lambda x: F.contains(q, x)))
    glob, pattern = q.rlike(r"[*?]"), glob_pattern(q)
    return (
        F.when(n == q, 1.0)
        .when(glob & F.regexp_like(n, F.concat(F.lit("^"), pattern, F.lit("$"))), 0.9)
        .when(glob & F.regexp_like(n, pattern), 0.75)
        .when(F.startswith(n, q), 0.85)
        .when(F.contains(n, q), 0.7)
        .when(F.startswith(q, n) & (F.length(n) >= 3), 0.65)
        .when(many & (hit_q == F.size(qp)), 0.8)
        .when(many & (hit_n == F.size(np)), 0.7)
        .when(many & ((hit_q > 0) | (hit_n > 0)), F.least(F.lit(0.79), 0.15 + 0.25 * best + 0.35 * tri))
        .when((F.size(words) > 1) & (said > 0), 0.3 + 0.3 * said / F.size(words))
        .when((F.length(n) >= 3) & F.contains(q, n), 0.5)
        .when(tri >= 0.3, 0.1 + 0.3 * tri)
        .when(some > 0, 0.1 + 0.15 * some / F.greatest(F.size(long), F.lit(1)))
        .otherwise(0.05)
    )


def token_rank(t: Column) -> Column:
    """How telling a token of a task is: paths 4, punctuation 3, digits 2, length 1."""
    return F.when(t.rlike(r"[/\\]"), 4).otherwise(0) + F.when(t.rlike(r"[._-]"), 3).otherwise(0) + F.when(t.rlike("[0-9]"), 2).otherwise(0) + F.when(F.length(t) >= 8, 1).otherwise(0)


#: Words that say nothing in a task's text, first English ones, then those common in code.
STOP_WORDS = (
    "a about an and are as at be been between by can could do does end explain for from had have how id in is it its just know much of on only or please some "
    "task than that the them they this through to understand very was were what when where which who why with would "
    "add all app args build call check class code config create data default delete error event export file find function generate get handle has help import index "
    "info init input item key let list load log make map message method module name new node not null object option options output parse path process query read "
    "remove report request response result return run save send server set should show start state status stop string test text token type update use util value var "
    "version want will work write"
).split()
#: Words that do not join to names.
JOIN_STOP_WORDS = "the and for with from that this have are was not but has how does what when where which about into through during before after should would could being been will than also need understand investigate check look find".split()


def seed_tokens(c: Column, most: int = 24) -> Column:
    """The most telling distinct tokens of a text, best first, of equal ones the longer, then the earlier."""
    kept = F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$") & t.rlike("[a-z]")))
    ranked = F.array_sort(F.transform(kept, lambda t, i: F.struct((-token_rank(t)).alias("r"), (-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda s: s["t"]), 1, most)


#: Fixed value: camel-case, snake-case and dotted names.
IDENTIFIER = r"([A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)"


def identifiers(c: Column) -> Column:
    """Distinct camel-case, snake-case and dotted names in a text, in order."""
    t = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.regexp_extract_all(t, F.lit(IDENTIFIER), 1))


def join_words(c: Column) -> Column:
    """Words of three letters or more that may join to names, in lower case."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([a-zA-Z]{3,})"), 1), F.lower), lambda x: ~x.isin(JOIN_STOP_WORDS))


def compounds(w: Column) -> Column:
    """Names that adjacent ones of ``join_words``, which should be a column of their own, may form.

    The first ten different pairs as camel, Pascal and snake case, then different triples as
    camel and Pascal case until there are 40 names.
    """
    part = lambda at, size: F.slice(w, at, F.greatest(F.size(w) - size + 1, F.lit(0)))
    two = lambda size: F.zip_with(part(1, size), part(2, size), lambda a, b: F.concat_ws("_", a, b))
    pairs = F.slice(F.array_distinct(two(2)), 1, 10)
    triples = F.array_distinct(F.zip_with(two(3), part(3, 3), lambda a, b: F.concat_ws("_", a, b)))
    triples = F.slice(triples, 1, F.ceil((40 - 3 * F.size(pairs)) / 2).cast("int"))
    pascal = lambda p: F.array_join(F.transform(F.split(p, "_"), F.initcap), "")
    camel = lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substring(pascal(p), 2, 1 << 30))
    return F.concat(F.flatten(F.transform(pairs, lambda p: F.array(camel(p), pascal(p), p))), F.flatten(F.transform(triples, lambda p: F.array(camel(p), pascal(p)))))


#: Default patterns of secrets in order, with their names; letter case does not matter, and ``\\b`` is
#: the edge of a run of ASCII letters, digits and ``_``.
SECRETS = [
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16,32}\b"),
    ("github-token", r"\bghp_[a-zA-Z0-9]{36}\b"),
    ("api-key", r"\bapi[_-]?key\s*[=:]\s*[\"']?[a-zA-Z0-9]{20,}[\"']?\b"),
    ("password", r"\bpassword\s*[=:]\s*[\"']?[^\"'\s]{8,}[\"']?\b"),
    ("connection-string", r"\b(mongodb://|postgres://|mysql://)[a-zA-Z0-9_\-.:@/]+\b"),
    ("jwt-token", r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b"),
    ("private-key", r"-----BEGIN\s+[A-Z\s]+PRIVATE\s+KEY-----"),
    ("env-variable", r"\b(?:SECRET|TOKEN|APIKEY|API_KEY|AUTH|CREDENTIAL|PRIVATE|PASSWORD)[A-Z_]*\s*[=:]\s*[\"']?[a-zA-Z0-9_\-/+=]{16,}[\"']?\b"),
]
#: Mail addresses, for callers that want them gone as well.
MAIL = ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
#: Ends of paths that hold secrets.
SECRET_ENDS = (".env", ".env.local", ".env.production", ".env.development", ".env.test", ".key", ".pem", "credentials.json", "secrets.yaml", "secrets.yml", ".secrets", "config/secrets.json", ".aws/credentials")
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def redacted(c: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """``c`` with every secret replaced by its name in brackets; null stays null. Own patterns come before ``SECRETS`` by ``[*own, *SECRETS]``."""
    for name, pattern in SECRETS if patterns is None else patterns:
        # White space of all scripts, as the patterns mean it.
        wide = pattern.replace(r"\b", _EDGE).replace(r"[^\"'\s]", r"[^\"'\s\p{Z}\x{FEFF}\x0B]").replace(r"\s*", r"[\s\p{Z}\x{FEFF}\x0B]*").replace(r"\s+", r"[\s\p{Z}\x{FEFF}\x0B]+").replace(r"[A-Z\s]", r"[A-Z\s\p{Z}\x{FEFF}\x0B]")
        c = F.regexp_replace(c, "(?i)" + wide, f"[REDACTED:{name}]")
    return c


def may_hold_secrets(path: Column) -> Column:
    """Whether a path ends like one that holds secrets, with either kind of slash."""
    p = F.translate(path, "\\", "/")
    return functools.reduce(lambda a, b: a | b, (F.endswith(p, F.lit(x)) for x in SECRET_ENDS))


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test, without letter case."""
    return F.lower(path).rlike(r"(^|/)tests/|\.test\.|\.spec\.")


def is_test_file(path: Column) -> Column:
    """Whether a path names a test: by its ending, or in any language under a folder of tests; what lies among test inputs does not."""
    return path.rlike(r"\.(test|spec)\.(ts|js)$|(^|/)(tests|__tests__)/") & ~path.rlike("/(fixtures|__fixtures__|testdata|test-data|mocks|stubs)/")


def plain_type(c: Column, depth: int = 6) -> Column:
    """A type's name without its arguments in angle brackets, nested up to ``depth``."""
    for _ in range(depth):
        c = F.regexp_replace(c, "<[^<>]*>", "")
    return F.trim(c)


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a text."""
    raw = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    bytes_ = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(bytes_, F.lit(2166136261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("bigint"), F.lit(1 << 32).cast("bigint")))


def file_id(repo: Column, path: Column) -> Column:
    """sha256 of repository and path."""
    return F.sha2(F.concat_ws(":", repo, path), 256)


def encode_target(prefix: str, name: Column) -> Column:
    """A name as an unresolved target: the prefix and its URL-safe base64 without padding."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.translate(F.base64(F.encode(name, "UTF-8")), "+/", "-_"), "=+$|[\r\n]", ""))


def decode_target(prefix: str, target: Column) -> Column:
    """The name behind an unresolved target of ``encode_target``, null if it has another prefix or is none."""
    code = F.translate(F.substring(target, len(prefix) + 1, 1 << 30), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.startswith(target, F.lit(prefix)), F.try_to_binary(padded, F.lit("base64")).cast("string"))


def duration_text(ms: Column) -> Column:
    """Milliseconds as at most two units, such as ``1h 5m``."""
    s = F.floor(ms / 1000)
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    return F.when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", m, "m")).when(m > 0, two(m, "m", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))
