"""Credentials in source code: found by record and line, and redacted in place.

A code is cut lexically into string literals and comments.  A literal is a
credential where it is assigned or passed to a credential-named identifier (a
variable, key, parameter, property, header, setter, login or key constructor, or
the fallback of a lookup), unless it is a placeholder.  URLs, `name = value` lines
inside texts and comments, tokens of well-known formats and private key blocks
count wherever they stand.  Redaction replaces the contents of the value alone;
quotes, prefixes, escapes around it and everything else stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallel

REDACTED = "REDACTED"

# The last words of identifiers that hold credentials, joined in lower case.
ROOTS = (
    "password passwd passphrase passcode secret token apikey authkey accesskey secretkey signingkey encryptionkey privatekey accountkey masterkey sharedkey accesskeyid keyid "
    "credential credentials authorization clientsecret"
).split()
#: Short last words, which count only as words of their own or in these joins.
SHORT = "pass pwd pw pat sas psk pin".split()
JOINED_SHORT = "dbpass userpass adminpass rootpass mypass dbpwd userpwd adminpwd adminpw bindpw ldapbindpw dbpw userpw rootpw deploypat storagesas accountsas".split()
#: Names that end like credentials and are none.
HARMLESS = "csrftoken xsrftoken pagetoken nexttoken continuationtoken nextpagetoken cachekeyid publickeyid".split()
#: Values that stand for a value.
EMPTY_WORDS = (
    "none null nil undefined true false yes no changeme changeit change-me change_me replaceme replace-me replace_me todo tbd fixme xxx dummy example sample placeholder redacted masked hidden removed "
    "unset empty default required optional string text str value test n/a na your-secret your_password yourpassword your-password yourtoken your-token your_api_key your-api-key insert-here unknown"
).split()
LOGINS = "login logon authenticate sign_in signin bind getconnection basic_auth basicauth httpbasicauth passwordcredentials usernamepasswordcredentials passwordauthentication connect auth".split()
KEYED_CALLS = "new secretkeyspec fernet ivparameterspec pbekeyspec hmacsha256".split()
GETTERS = ("get", "read", "ask", "prompt", "is", "has", "check", "validate", "verify", "find", "lookup", "fetch", "request", "require", "load", "flash", "input", "log", "print", "warn", "info", "debug", "error")

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@lru_cache(maxsize=100_000)
def names_credential(name: str) -> bool:
    """Whether an identifier, key, option or header says that its value is a credential."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    joined = "".join(words)
    if joined in HARMLESS:
        return False
    if words[-1] in SHORT or joined in JOINED_SHORT or any(joined.endswith(x) for x in JOINED_SHORT if len(x) > 5):
        return True
    if "public" in words[-3:]:
        return False
    return any(joined.endswith(root) for root in ROOTS)


_MASK = re.compile(r"(.)\1*|[*•.xX#?_\- ]+")
_TEMPLATE = re.compile(r"\$\{[^}]*\}|\{\{.*\}\}|\{[\w.:!]*\}|<[^<>]*>|%\(\w+\)s|%[sd]|\$[A-Za-z_]\w*|\$\([^)]*\)|@[\w.]+@|\[[A-Za-z _-]+\]|%\w+%|#\{[^}]*\}|__\w+__")
_STRONG = re.compile(r"\d|[^\w\s.,;:!?'\"()-]|[a-z][A-Z]")


@lru_cache(maxsize=100_000)
def placeholder(value: str) -> bool:
    """Empty values, masks, templates, lookups, stand-in words, and names of fields."""
    text = value.strip().strip("'\"`")
    if len(text) < 4 or _MASK.fullmatch(text) or _TEMPLATE.fullmatch(text):
        return True
    low = text.lower()
    if low in EMPTY_WORDS or low.startswith(("your-", "your_", "your ", "example-", "dummy-", "changeme", "change_me", "replace", "insert", "os.environ", "env:", "vault:", "secret://", "arn:aws:secretsmanager", "{{", "${", "$(", "%(", "<", "env(", "system.getenv")):
        return True
    if low.endswith("example") or "xxxxx" in low or "*****" in low:
        return True
    # A field's name, not its value: words only, the last of which name a credential.
    return bool(re.fullmatch(r"[A-Za-z]+(?:[_.\-][A-Za-z]+)*:?", text)) and names_credential(text.rstrip(":"))


def strong(value: str) -> bool:
    """A value that does not read as a word of a sentence."""
    return len(value) >= 6 and bool(_STRONG.search(value))


#: Signs of a credential, derived from the rules behind them, so that no text in which a rule finds something lacks them all.
#: Long last words, sought in the text's ASCII letters and digits alone, as a name's words are joined; those within others aren't repeated.
_LONG = {*ROOTS, *JOINED_SHORT}
_SIGNS = tuple(sorted(x.encode() for x in _LONG if not any(y != x and y in x for y in _LONG)))
_LOWERED = bytes(range(256)).lower()
_APART = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
#: Short last words, calls of logins and keys, and literals compared with something.
_SHORT_SIGN = re.compile(rf"(?:{'|'.join(SHORT)})(?![A-Za-z])|(?:{'|'.join(LOGINS + KEYED_CALLS)})\s*\(|[\"']\s*(?:\.equals\(|[!=]=)", re.IGNORECASE)
#: What tokens of known formats and key blocks begin with.
_MARKS = ("PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "AIza", "eyJ", "_pat_", "_tok_", "_key_")


def _hinted(text: str) -> bool:
    """Whether a text may hold a credential at all."""
    joined = text.encode(errors="replace").translate(_LOWERED, _APART)
    if any(sign in joined for sign in _SIGNS) or any(mark in text for mark in _MARKS):
        return True
    if "://" in text and "@" in text:
        return True
    return _SHORT_SIGN.search(text) is not None


_STRINGS = r'"""(?:\\.|[^\\])*?"""' + r"|'''(?:\\.|[^\\])*?'''" + r'|"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
_PYTHON = re.compile(rf"(?P<comment>#[^\n]*)|(?P<string>{_STRINGS})", re.DOTALL)
_JAVA = re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_STRINGS})", re.DOTALL)

_ASSIGNED = re.compile(r"(?:\[\s*[\"']([\w.\-]+)[\"']\s*\]|([A-Za-z_$][\w$]*))\s*(?::\s*[A-Za-z_][\w\[\], .]*)?=\s*\(?\s*[rbfuRBFU]{0,2}$")
_ENTRY = re.compile(r"[\"']([\w.\- ]+)[\"']\s*:\s*\(?\s*[rbfuRBFU]{0,2}$")
_PASSED = re.compile(r"([A-Za-z_]\w*)\s*\(\s*[\"']([\w.\-]+)[\"']\s*,\s*(?:default\s*=\s*|defaultValue\s*=\s*)?[rbfuRBFU]{0,2}$")
_CALLED = re.compile(r"([A-Za-z_]\w*)\s*\(\s*[rbfuRBFU]{0,2}$")
_ARGUMENT = r"(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_][\w.]*)"
_LOGIN = re.compile(rf"([A-Za-z_]\w*)\s*\(\s*(?:{_ARGUMENT}\s*,\s*){{1,2}}$")
_COMPARED = re.compile(r"([A-Za-z_][\w.]*)\s*(?:(?:\.equals|\.equalsIgnoreCase|\.contentEquals)\s*\(\s*|[!=]==?\s*)$")
_COMPARES = re.compile(r"\s*(?:\.equals\(\s*([\w.]+)\s*\)|[!=]=\s*([A-Za-z_][\w.]*))")
_JOIN = re.compile(rf"\s*(?:\+\s*)?(?:{_STRINGS})", re.DOTALL)
_GRANTS = re.compile(r"[^\n]*\n?\s*(?:\w*(?:granted|passed|allowed|authori[sz]ed|authenticated|admin|ok|valid)\w*\s*=|return\s+true)", re.IGNORECASE)

_TOKEN = re.compile(
    r"(?<![\w/+.-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|[a-z]+_(?:pat|tok|key)_[A-Za-z0-9]{16,})(?![\w/+-])"
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/=]{8,}")
#: A key's short last line, ahead of its END mark.
_KEY_TAIL = re.compile(r"(?<![\\A-Za-z0-9+/=])[A-Za-z0-9/][A-Za-z0-9+/=]{0,6}(?=(?:\\[nr]|[\s\"',;+])*\Z)")
_BODY = re.compile(r"[\s\"'+#*/;,]*(?:\\[nr][\s\"'+#*/;,]*)*[A-Za-z0-9+/=]{12}")
_USERINFO = re.compile(r"(?<![\w+.-])[A-Za-z][\w+.-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
_QUERY = re.compile(r"[?&;]([\w.\-]+)=([^&\s\"'<>;]+)")
_FALLBACK = re.compile(r"\$\{([\w.\-]+):-?([^${}]+)\}")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|token|bearer|basic|ApiKey|Digest|SharedKey)\s+")
#: A header as a text of its own: its name, and a scheme or none before the value.
_HEADER = re.compile(r"\s*([A-Za-z][\w\-]*)\s*:\s*((?:Bearer|Basic|Token|ApiKey|Digest|SharedKey)\s+)?([^\s\"']+)\s*\Z", re.IGNORECASE)
_LINE_PAIR = re.compile(r"(?<![\w.$-])([A-Za-z_][\w.\-]*)[\"']?[ \t]*(=|:|->|=>|\bwas\b|\bis\b)[ \t]*([\"']?)([^\s\"',;]+)\3", re.IGNORECASE)
_HEADERS = ("authorization", "proxyauthorization")


class Finding:
    """One credential: where it begins, its parts to redact, and how it was recognised."""

    __slots__ = ("kind", "parts", "start")

    def __init__(self, start: int, parts: list[tuple[int, int]], kind: str) -> None:
        self.start, self.parts, self.kind = start, parts, kind


def _inner(code: str, start: int, end: int) -> tuple[int, int]:
    """The contents of the string literal at start..end."""
    quote = 3 if code[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
    return start + quote, end - quote


def _joined(code: str, end: int) -> list[tuple[int, int]]:
    """The contents of literals that are joined to one that ends at `end`."""
    parts = []
    while (m := _JOIN.match(code, end)) is not None:
        at = next(i for i in range(m.start(), m.end()) if code[i] in "\"'")
        parts.append(_inner(code, at, m.end()))
        end = m.end()
    return parts


def _context(code: str, start: int, end: int, value: str) -> str | None:
    """How the code around a literal makes it a credential."""
    before = code[max(0, start - 240) : start]
    tail = before.rstrip()[-1:]
    if m := _ASSIGNED.search(before):
        name = m[1] or m[2]
        if names_credential(name):
            return "assigned"
        # A default of an option or lookup is judged by the name passed with it.
        if not name.lower().startswith("default"):
            return None
    if tail == ":" and (m := _ENTRY.search(before)):
        return "entry" if names_credential(m[1]) else None
    if (tail in "," or tail == "=") and (m := _PASSED.search(before)):
        if names_credential(m[2]):
            return "passed"
    if tail == "," and (m := _LOGIN.search(before)):
        if m[1].lower() in LOGINS and code[end : end + 12].lstrip()[:1] == ")":
            return "login" if m[1].lower() not in ("bind", "connect", "auth") or strong(value) else None
        return None
    if tail == "(" or before[-1:] in "rbfuRBFU":
        if m := _CALLED.search(before):
            name = m[1]
            low = name.lower()
            if low in KEYED_CALLS:
                if low != "new":
                    return "key"
                return "key" if re.search(r"hmac\s*\.\s*new\s*\(\s*b?$", before) else None
            if names_credential(name) and not low.startswith(GETTERS):
                return "set"
    if m := _COMPARED.search(before):
        return "compared" if names_credential(m[1].rsplit(".", 1)[-1]) else None
    if m := _COMPARES.match(code, end):
        name = (m[1] or m[2]).rsplit(".", 1)[-1]
        if names_credential(name) or (strong(value) and _GRANTS.match(code, m.end())):
            return "compared"
    return None


def _text_findings(code: str, start: int, end: int, comment: bool, found: list[Finding]) -> None:
    """Credentials inside a text: key blocks, URLs, tokens of known formats, and name-value pairs on its lines."""
    text = code[start:end]
    for m in _BEGIN.finditer(text):
        if not _BODY.match(code, start + m.end()):
            continue
        stop = _KEY_END.search(code, start + m.end())
        stop_at = stop.start() if stop else end
        # The key's lines, between which quotes and joins stay.
        parts = [k.span() for k in _KEY_LINE.finditer(code, start + m.end(), stop_at)]
        if stop and (tail := _KEY_TAIL.search(code, max(start + m.end(), stop_at - 64), stop_at)) and not any(a <= tail.start() < b for a, b in parts):
            parts.append(tail.span())
        found.append(Finding(start + m.start(), parts, "private key"))
    if "://" in text:
        for m in _USERINFO.finditer(text):
            if not placeholder(m[1]) and "{" not in m[1] and "$" not in m[1][:1]:
                found.append(Finding(start + m.start(1), [(start + m.start(1), start + m.end(1))], "url"))
    if "=" in text:
        for m in _QUERY.finditer(text):
            if names_credential(m[1]) and not placeholder(m[2]) and not _TEMPLATE.match(m[2]):
                found.append(Finding(start + m.start(2), [(start + m.start(2), start + m.end(2))], "query"))
    if "${" in text:
        for m in _FALLBACK.finditer(text):
            if names_credential(m[1]) and not placeholder(m[2]):
                found.append(Finding(start + m.start(2), [(start + m.start(2), start + m.end(2))], "fallback"))
    for m in _TOKEN.finditer(text):
        if not placeholder(m[0]):
            found.append(Finding(start + m.start(), [(start + m.start(), start + m.end())], "token"))
    if comment or "\n" in text:
        at = 0
        while m := _LINE_PAIR.search(text, at):
            name, mark, value = m[1], m[2].lower(), m[4]
            at = m.end(2)  # the value may itself be the next pair's name
            if not names_credential(name) or placeholder(value) or "://" in value:
                continue
            if (comment or mark in ("was", "is")) and not strong(value.rstrip(".")):
                continue
            at = m.end()
            found.append(Finding(start + m.start(4), [(start + m.start(4), start + m.end(4))], "pair"))


def credentials(code: str, java: bool) -> list[Finding]:
    """All credentials of a code in order; values found in several ways count once."""
    if not code or not _hinted(code):
        return []
    found: list[Finding] = []
    covered = 0
    for m in (_JAVA if java else _PYTHON).finditer(code):
        start, end = m.span()
        if start < covered:
            continue
        if m.lastgroup == "comment":
            if _hinted(code[start:end]):
                _text_findings(code, start, end, True, found)
            continue
        low, high = _inner(code, start, end)
        value = code[low:high]
        if not value:
            continue
        before = len(found)
        if len(value) > 15 or "\n" in value:
            _text_findings(code, low, high, False, found)
        if any(f.kind == "private key" for f in found[before:]):
            covered = max([end, *(b for f in found[before:] for _, b in f.parts)])
            continue
        if "\n" in value and high - low > 6:
            continue
        if any(f.kind != "token" for f in found[before:]):
            continue
        if (m := _HEADER.match(value)) and names_credential(m[1]) and not placeholder(m[3]) and not _TEMPLATE.search(m[3]) and (m[2] or strong(m[3])):
            del found[before:]
            found.append(Finding(low + m.start(3), [(low + m.start(3), low + m.end(3))], "header"))
            continue
        scheme = _SCHEME.match(value)
        bare = value[scheme.end() :] if scheme else value
        if len(found) > before and (" " in bare or bare.startswith("data:")):
            continue
        parts = _joined(code, end) if code[end : end + 400].lstrip()[:1] in ("+", '"', "'") else []
        whole = bare + "".join(code[a:b] for a, b in parts)
        if " " in bare or not whole or (placeholder(whole)):
            continue
        if not parts and placeholder(bare):
            continue
        kind = _context(code, start, end, whole)
        if kind is None:
            continue
        if kind in ("assigned", "entry", "passed", "set") and ("://" in bare or bare.endswith(("=", "?")) and not strong(bare)):
            continue
        del found[before:]
        found.append(Finding(low + (scheme.end() if scheme else 0), [(low + (scheme.end() if scheme else 0), high), *parts], kind))
        if parts:
            covered = parts[-1][1]
    found.sort(key=lambda f: f.start)
    out: list[Finding] = []
    for f in found:
        if out and out[-1].parts and f.start < out[-1].parts[-1][1]:
            continue
        out.append(f)
    return out


def redacted(code: str, java: bool) -> str:
    """The code with the contents of every credential replaced; without one it is returned as it is."""
    out, at = [], 0
    for f in credentials(code, java):
        for i, (a, b) in enumerate(f.parts):
            if a < at:
                continue
            out.append(code[at:a])
            out.append(REDACTED if i == 0 else "")
            at = b
    return "".join(out) + code[at:] if out else code


def is_java(code: str, language: str | None) -> bool:
    """Whether a code is read as Java: by its named language, else by its line ends."""
    named = (language or "").strip().lower()
    if named.startswith("java"):
        return True
    if named.startswith("py"):
        return False
    return len(re.findall(r"[;{}][ \t]*$", code, re.MULTILINE)) > len(re.findall(r":[ \t]*$", code, re.MULTILINE))


def _codes(holdout: DataFrame, owasp: DataFrame) -> DataFrame:
    one = holdout.select(F.lit("holdout").alias("table_name"), F.col("entry_id").alias("rec_id"), "language", F.col("before").alias("code"))
    two = owasp.select(F.lit("owasp_entries").alias("table_name"), F.col("code_id").alias("rec_id"), "language", "code")
    return one.unionByName(two)


def findings(holdout: DataFrame, owasp: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no, kind) of every credential.

    Null and empty codes have none.  Lines are numbered from 1 and end with \\n.
    """
    schema = "table_name string, rec_id bigint, line_no bigint, kind string"

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for table, rec, language, code in zip(*(batch.column(c).to_pylist() for c in ("table_name", "rec_id", "language", "code")), strict=True):
                for f in credentials(code, is_java(code, language)) if code else ():
                    for column, value in zip(rows, (table, rec, code.count("\n", 0, f.start) + 1, f.kind), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())], ["table_name", "rec_id", "line_no", "kind"])

    return parallel(_codes(holdout, owasp).where("code is not null and code != ''")).mapInArrow(run, schema)


def found(holdout: DataFrame, owasp: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no) of every line on which a credential begins, each once.

    A record's rows come from one task and ids are unique in a table, so repeated
    lines are dropped by a small aggregation over findings, not over codes.
    """
    return findings(holdout, owasp).select("table_name", "rec_id", "line_no").distinct()


def redaction(holdout: DataFrame, owasp: DataFrame) -> DataFrame:
    """(table_name, rec_id, credentials, code): every code, its credentials redacted; null codes stay null."""
    schema = "table_name string, rec_id bigint, credentials int, code string"

    def run(batches):
        for batch in batches:
            counts, codes = [], []
            for language, code in zip(batch.column("language").to_pylist(), batch.column("code").to_pylist(), strict=True):
                java = is_java(code, language) if code else False
                n = len(credentials(code, java)) if code else 0
                counts.append(n)
                codes.append(redacted(code, java) if n else code)
            yield pa.RecordBatch.from_arrays([batch.column("table_name").cast(pa.string()), batch.column("rec_id").cast(pa.int64()), pa.array(counts, pa.int32()), pa.array(codes, pa.string())], ["table_name", "rec_id", "credentials", "code"])

    return parallel(_codes(holdout, owasp)).mapInArrow(run, schema)
