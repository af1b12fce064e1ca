"""What names of calls, conditions and paths say: predicates as column expressions over tables of needles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import any_of
from .metrics import confusion

# Fixed values.
HTTP_CLIENTS = ("requests.", "urllib.", "httpx.", "aiohttp.", "http.client", "urlopen", "openconnection", "openstream", "httpclient", "httpurlconnection", "webflux", "resttemplate", "webclient.", "okhttp", "httprequest", "fetch")
NOT_WEB = ("os.remove", "os.unlink", "os.rmdir", "shutil.rmtree", "system.out", "system.err", "logger.", "log.", "logging.", "stderr", "stdout")
WEB_WRITERS = ("response.write", "getwriter", "printwriter", "out.print", "out.println", "render_template", "httpresponse", "servletresponse", "responsewriter", "sendresponse")
PRINTS = ("print", "println", "write", "printf")
NOT_WRITERS = ("file", "stream", "bytearray", "objectoutput", "buffered", "stringwriter", "stringbuilder")
WRITER_WORDS = ("writer", "response", "out")
#: Words of a guard's condition and the weakness that it guards against; without one, DEFAULT_GUARDED.
GUARDED = (("CWE-918", ("url", "host", "ip")), ("CWE-22", ("path", "file", "dir", "startswith", "contains")), ("CWE-89", ("sql", "query")), ("CWE-79", ("html", "xss", "script")))
DEFAULT_GUARDED = ("CWE-22", "CWE-89")
WRITING = ("dump", "dumps", "encode", "save", "write", "export", "serialize")
SAFE_LOADERS = ("safeloader", "baseloader")
UNSAFE_CALLS = (
    "deserialize", "pickle.load", "yaml.load", "yaml.unsafe_load", "msgpack.unpack", "jsonpickle.decode", "marshal.load", "shelve.open", "dbm.open", "joblib.load", "torch.load", "numpy.load",
    ".from_yaml", ".from_pickle", "readobject", "readunshared", "readvalue", "readtree",
)
UNSAFE_METHODS = ("unsafe_load", "unpackb")
JSON_PARSERS = ("json.", "ujson.", "orjson.")
TOML_PARSERS = ("toml.", "tomli.", "tomlkit.")
CERTIFICATES = ("asn1crypto", "cryptography", "certificate", "cert", "x509")
LOADS = ("load", "loads", "unpack", "unpackb", "decode", "deserialize", "readobject", "readvalue")
UNSAFE_TYPES = ("pickle", "yaml", "jsonpickle", "msgpack", "objectinputstream", "xmldecoder", "objectmapper")


def _starts(text: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for head in heads:
        out = out | F.coalesce(text.startswith(head), F.lit(False))
    return out


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def http_client(callee: Column) -> Column:
    """Whether a call is one of an HTTP client."""
    return any_of(F.lower(callee), HTTP_CLIENTS)


def web_writer(callee: Column) -> Column:
    """Whether a call writes to a web response: never files, consoles and logs; printing methods only on what sounds like a writer, or bare."""
    low = F.lower(callee)
    bare = low.isin(*PRINTS)
    prints = (bare | (low.contains(".") & _last(low).isin(*PRINTS))) & ~any_of(low, NOT_WRITERS) & (bare | any_of(low, WRITER_WORDS))
    return F.coalesce(~any_of(low, NOT_WEB) & (any_of(low, WEB_WRITERS) | prints), F.lit(False))


def guarded_weaknesses(condition: Column) -> Column:
    """The weaknesses that a guard with this condition guards against, as an array."""
    low = F.lower(condition)
    named = F.filter(F.array(*(F.when(any_of(low, words), F.lit(cwe)) for cwe, words in GUARDED)), lambda c: c.isNotNull())
    return F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, DEFAULT_GUARDED)))


def test_file(path: Column) -> Column:
    """Whether a path is that of a test; benchmark cases are none.  A null path is none."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(low, "/"), -1)
    case = low.contains("benchmark") | name.startswith("test_cwe_")
    test = any_of(low, ("/tests/", "/test/", "/test_")) | name.startswith("test_") | name.endswith("_test.py") | name.endswith("_test.java") | name.contains(".test.")
    return F.coalesce(~case & test, F.lit(False))


def unsafe_deserializer(callee: Column, receiver: Column | None = None, arguments: Column | None = None) -> Column:
    """Whether a call reads objects from data in a way that may run code.

    `receiver` is the full name of the receiver's type, `arguments` the text of all
    arguments; both may be null.  Safe variants, writing methods, loads with a safe
    loader and parsers of plain data are none.
    """
    low = F.lower(callee)
    kind = F.coalesce(F.lower(receiver), F.lit("")) if receiver is not None else F.lit("")
    given = F.coalesce(F.lower(arguments), F.lit("")) if arguments is not None else F.lit("")
    method = _last(low)
    wrapper = any_of(kind, ("safe", "validat")) & (method.startswith("read") | (method == "deserialize"))
    harmless = wrapper | (method.contains("safe") & ~method.contains("unsafe")) | low.startswith("struct.") | (kind == "struct") | kind.endswith(".struct") | method.isin(*WRITING) | (low.contains("yaml.load") & any_of(given, SAFE_LOADERS))
    plain = any_of(low, CERTIFICATES) | any_of(kind, CERTIFICATES) | any_of(kind, ("json", "toml")) | _starts(low, JSON_PARSERS + TOML_PARSERS)
    loads = (method == "loads") & ~_starts(low, (*JSON_PARSERS, "simplejson."))
    by_type = method.isin(*LOADS) & any_of(kind, UNSAFE_TYPES) & ~any_of(kind, tuple(c for c in CERTIFICATES if c != "cert"))
    risky = any_of(low, UNSAFE_CALLS) | any_of(kind, ("deserializer", "deserialisation")) | method.isin(*UNSAFE_METHODS) | loads | ((method == "load") & ~plain) | by_type
    return F.coalesce(~harmless & risky, F.lit(False))


def paths_may_alias(left: DataFrame, right: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of access paths (file_id, root, path array) of two tables that may be one place: equal, or of equal segments on roots that may alias.

    `aliases` has file_id, a and b, each pair once.  An equi-join on the segments and
    on the roots' possible names, without pairing all paths.
    """
    both = aliases.select("file_id", "a", "b").unionByName(aliases.select("file_id", F.col("b").alias("a"), F.col("a").alias("b")))
    own = left.select("file_id", F.col("root").alias("a"), F.col("root").alias("b")).distinct()
    names = both.unionByName(own).distinct()
    x = left.select("file_id", F.col("root").alias("a"), "path").join(names, ["file_id", "a"])
    return x.join(right.select("file_id", F.col("root").alias("b"), "path"), ["file_id", "b", "path"]).select("file_id", F.col("a").alias("left_root"), F.col("b").alias("right_root"), "path").distinct()


def good_and_bad(found: DataFrame, stems: DataFrame) -> DataFrame:
    """Counts and scores of a suite whose files have one bad and one good case each.

    `found` has stem and method of each finding's source, `stems` the files' stems.
    A finding in a method named good counts against the good case, one named bad, or
    code outside of methods, for the bad one.
    """
    good = F.col("method").rlike("[gG]ood")
    bad = F.col("method").rlike("[bB]ad") | (~good & (F.col("method") == "__module__"))
    hit = found.groupBy("stem").agg(F.bool_or(bad).alias("bad"), F.bool_or(good).alias("good"))
    cases = stems.select("stem").distinct().join(hit, "stem", "left")
    rows = cases.select(F.explode(F.array(*(F.struct(F.coalesce(c, F.lit(False)).alias("predicted"), F.lit(c == "bad").alias("actual")) for c in ("bad", "good")))).alias("r")).select("r.predicted", "r.actual")
    return confusion(rows)
