"""Finding and blanking out credentials in source code, configuration and prose."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import small_enough

#: Strings of which at least one stands on or right before each line that is looked at closely.
KEYWORDS = (
    "pass", "pwd", "pw", " -p", " -u", "db(", "connect(", "secret", "token", "key", "seed", "auth", "cred", "bearer", "basic", "login", "conn", "storage", "dsn", "sig=", "salt", "pin",
    "private", "://", "akia", "asia", "aiza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_", "rk_", "pk_live", "sk-", "eyj",
    "npm_", "pypi-", "hf_", "sg.", "shpat_", "dop_v1_", "ya29.", "aws", "pgp", "webhook", "accountkey", "sharedaccess",
)
#: Formats that issuers give their tokens, each with a group for the secret.
ISSUED = (
    r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    r"\b(github_pat_[A-Za-z0-9_]{40,})\b",
    r"\b(glpat-[A-Za-z0-9_-]{20,})",
    r"\b(AIza[0-9A-Za-z_-]{35})",
    r"\b(xox[abposr]-[0-9A-Za-z-]{10,})",
    r"\b((?:sk|rk|pk)_live_[0-9A-Za-z]{16,})\b",
    r"\b(sk-[A-Za-z0-9_-]{32,})",
    r"\b(npm_[A-Za-z0-9]{36})\b",
    r"\b(pypi-[A-Za-z0-9_-]{50,})",
    r"\b(hf_[A-Za-z0-9]{30,})\b",
    r"\b(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})",
    r"\b(shpat_[a-f0-9]{32})\b",
    r"\b(dop_v1_[a-f0-9]{64})\b",
    r"\b(ya29\.[A-Za-z0-9_-]{30,})",
)
_ISSUED = re.compile("|".join(ISSUED))
#: What issuers put before the secret part.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|AIza|xox[abposr]-|[srp]k_live_|sk-|npm_|pypi-|hf_|SG\.|shpat_|dop_v1_|ya29\.")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_JWT = re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:\\r|\\n|[\s\"'`+#/*>|-])*(?:[A-Za-z]+-?[A-Za-z]+: [^\n]*\n[\s#/*>|]*)*([A-Za-z0-9+/=]{20,})")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://([^\s/:@\"'`<>]*):([^\s@\"'`]+)@[A-Za-z0-9\[]")
_AUTH = re.compile(r"\b(?:proxy-)?authorization[\"'`]?\s*[:=]\s*[\"'`]?\s*(bearer|basic|token|apikey)\s+([^\s\"'`,;]+)", re.I)
_QUERY = re.compile(r"[?&;](?:api_?key|apikey|access_token|auth|auth_token|token|sig|signature|secret|client_secret|password|pwd|key)=([^&\s\"'`;,)>]+)", re.I)
_PART = re.compile(r"\b(?:AccountKey|SharedAccessKey|SharedAccessSignature|Password|Pwd)=([^;\s\"'`]+)", re.I)
_LITERAL = re.compile(r"--(?:from-literal|set|env|build-arg)[= ]([A-Za-z0-9_.-]+)=([^\s\"'`]+)")
_FLAG = re.compile(r"--([a-z-]*(?:password|passwd|token|secret|api-key))[= ]+[\"']?([^\s\"'`]+)", re.I)
_MACHINE = re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(\S+)", re.I)
_LOGIN = re.compile(r"\b(?:login|credentials?|account|user)\b[^:\n]{0,40}:\s*\S+\s*/\s*(\S+)", re.I)
_WITH = re.compile(r"\b(?:login|logon|sign in|signin|account)\s+\S+\s+with\s+(\S+)", re.I)
_DASH = re.compile(r"(?:^|\s)-(?:p\s?[\"']([^\"'\s]+)[\"']|u\s+[\"']?[A-Za-z0-9._-]+:([^\s\"']+))")
_CALL = re.compile(r"\b(?:log_?[io]n|open_?db|open_?connection|connect|authenticate|auth|sign_?in|basic_?auth|bind|set_?password)\w*\s*\(([^()]*)\)", re.I)
_ARG = re.compile(r"(?:^|,)\s*([\"'`])((?:(?!\1).)+)\1\s*(?=,|$)")
_SAID = re.compile(r"\b(?:password|passwd|passphrase|secret|token|api key|pass)\b(?:\s+(?:for|of|on)\s+\S+)?\s+(?:is|was)(?:\s+(?:now|set to|still))?[:\s]+[\"'`]?([^\s\"'`]+)", re.I)
_PAIR = re.compile(r"(?<![A-Za-z0-9_$])([\"'`]?)([A-Za-z_][A-Za-z0-9_.-]*)\1(?:[\"'`]?\])?(?:\s*:\s*(?:&'?[a-z]*\s?)?(?:str|String|string|bytes))?\s*(=>|:=|=|:|\|)\s*(?![=>])")
_NAMED = re.compile(r"^[\s#/*-]*name:\s*[\"']?([A-Za-z_][A-Za-z0-9_.-]*)[\"']?\s*$")
_VALUE = re.compile(r"^([\s#/*]*)(?:\"?value\"?)\s*[:=]\s*")
_QUOTED = re.compile(r"([\"'`])((?:\\.|(?!\1).)*)\1")
_JOINED = re.compile(r"\s*(?:\+|,|\.|\s)\s*[\"'`]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Words of a name that make its value a secret, and last words that take that back.
SECRET_WORDS = frozenset("password passwd passwort passphrase pass pwd pw secret token apikey credential credentials seed pem pin salt cookie".split())
KEY_BEFORE = frozenset("api service signing ssh tls access private encryption secret deploy auth account master hmac client server license ssl rsa storage session shared signature crypt cipher aes admin root webhook".split())
MEEK_LAST = frozenset("name names path file column label pattern length len min max budget count days hours minutes ttl type kind url uri endpoint field header prefix suffix regex id ids expiry expires expiration limit limits rotation ref env var policy format text size index hint prompt placeholder title validator rules version algorithm issuer provider manager store class map table list enabled required usage total used per rate public window color colour icon separator sep delimiter stream scope scopes".split())
MEEK_FIRST = frozenset("max min num count total n public foreign primary sort partition cache token_type has is use uses no".split())
#: What stands where a secret would.
_REFERENCE = re.compile(
    r"^(?:\$|%[A-Za-z_{(]|<|\{\{|\{[A-Za-z_]|\[\[|@|!(?:Ref|Sub|GetAtt|vault|env|secret)|&|\*[a-z]|env[:.(\[]|vault[:.(/]|secret(?:s|ref)?[:.(/]|var\.|local\.|data\.|module\.|arn:|ref\+|op://|ssm:|file[:(]|keyring|config[.\[(]|settings\.|os\.|process\.|std::|System\.|getenv|ENV\[|self\.|this\.|args\.|request\.|ctx\.|(?-i:\.{0,2}/[a-z0-9_./-]*$)|~/|https?://)"
    r"|\$\{|\{\{|<[a-z_ -]+>|%\([a-z_]+\)s",
    re.I,
)
_MASKED = re.compile(r"^(?:[*•xX.#_\-?0]+|x{3,}.*|.*(?:\*{3,}|•{2,}|\.{3,}|…|x{5,}|X{5,}).*)$")
_PLACEHOLDER = re.compile(
    r"^(?:your|my|the|some|insert|enter|put|add|paste|replace|change|fill|todo|tbd|fixme|example|sample|dummy|fake|mock|redacted|removed|hidden|masked|none|null|nil|undefined|true|false|yes|no|on|off|empty|unset|default|string|str|optional|required|test|changeme|secret|password|passwort|token|key)(?:[_\-\s.]?(?:your|own|me|this|here|it|api|auth|access|client|deploy|service|signing|root|admin|smtp|db|hmac|webhook|secret|password|passwd|pass|pwd|token|key|seed|value|placeholder|string|with|in|a|real|one|id|here|example|only))*[\s.!]*$"
    r"|^your[_\- ]|example|placeholder|replace[_\- ]?(?:me|with|this)|change[_\- ]?me|not[_\- ]?a[_\- ]?(?:real|secret)|redacted",
    re.I,
)
_HEX_ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*(?:\(.*\)|\[.*\])?[;,]?$")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def secret_name(name: str) -> bool:
    """Whether a name announces a secret value: ``dbPassword`` does, ``password_min_length`` and ``max_tokens`` do not."""
    w = [x.lower() for x in _WORD.findall(name)]
    if not w or w[-1] in MEEK_LAST or w[0] in MEEK_FIRST:
        return False
    if any(x in SECRET_WORDS for x in w):
        return "tokens" not in w
    joined = "".join(w)
    if joined.endswith(("password", "passwd", "secret", "token", "apikey", "authtoken")):
        return True
    return w[-1] in ("key", "keys") and any(x in KEY_BEFORE for x in w[:-1])


def harmless(value: str, named: bool = True) -> bool:
    """Whether a value cannot be a secret itself: empty, masked, a placeholder, a reference, a pattern, an id or a word."""
    v = value.strip()
    if len(v) < 6 or blanked(v) or _REFERENCE.search(v) or _MASKED.match(v) or _PLACEHOLDER.search(v):
        return True
    if re.search(r"\[[^\]]*\]|\.\*|\\[dwsS]|\{\d+,?\d*\}|\(\?", v):
        return True
    if v.isdigit() and len(v) < 10:
        return True
    if _HEX_ID.fullmatch(v) or re.match(r"sha(?:1|224|256|384|512)[-:]", v) or v.startswith("-----BEGIN PUBLIC"):
        return True
    if len(set(v)) < 4:
        return True
    if re.fullmatch(r"[a-z]+(?:[_/ .-][a-z]+)*|[A-Z][a-z]+|[A-Z]+(?:_[A-Z]+)*", v):
        return True  # only words: a name or a path
    return not named and _entropy(v) < 3


def _strong(v: str) -> bool:
    """Whether an unnamed value looks made up to be hard to guess: letters, digits and marks, or both cases of letters."""
    return bool(not harmless(v) and len(v) >= 8 and re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and (re.search(r"[!$#%&*^+]", v) or re.search(r"[a-z]", v) and re.search(r"[A-Z]", v)) and not re.search(r"[\s:/@]|\.[a-z]{2,}$", v))


def _basic(value: str) -> bool:
    """Whether a value decodes to a login with a password that is none of the harmless ones."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, word = plain.partition(":")
    return bool(colon) and plain.isprintable() and not harmless(word)


def _jwt(value: str) -> bool:
    head = value.split(".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (binascii.Error, ValueError):
        return False


def _bare(rest: str) -> str:
    """The unquoted value at the start of ``rest``, up to a blank, a comment or a cell border."""
    m = re.match(r"[^\s\"'`|]+", rest)
    return m.group().rstrip(";,`)") if m else ""


def _literal(line: str, at: int) -> list[tuple[int, int]]:
    """Spans of the literal at ``at``: one, or several where it is put together from parts."""
    m = re.compile(r"\s*[\[(]?\s*[bfru]{0,2}(?=[\"'`])").match(line, at)
    if not m:
        return []
    spans, k = [], m.end()
    while (q := _QUOTED.match(line, k)) is not None:
        spans.append((q.start(2), q.end(2)))
        j = _JOINED.match(line, q.end())
        if not j:
            break
        k = j.end() - 1
    return spans


def _line_secrets(line: str, named: str | None) -> list[tuple[int, int]]:
    """Spans of the secrets in one line; ``named`` is the name that the line before gives its value."""
    found: list[tuple[int, int]] = []
    found += [m.span(m.lastindex) for m in _ISSUED.finditer(line) if not harmless(m.group(m.lastindex)) and "EXAMPLE" not in m.group()]
    found += [m.span(1) for m in _JWT.finditer(line) if _jwt(m.group(1))]
    for m in _URL.finditer(line):
        if not harmless(m.group(2)) or (len(m.group(2)) > 3 and not blanked(m.group(2)) and not _REFERENCE.search(m.group(2)) and not _MASKED.match(m.group(2)) and not _PLACEHOLDER.search(m.group(2))):
            found.append(m.span(2))
    for m in _AUTH.finditer(line):
        v = m.group(2)
        if (_basic(v) if m.group(1).lower() == "basic" else not harmless(v)):
            found.append(m.span(2))
    for rx in (_QUERY, _PART, _MACHINE, _LOGIN, _SAID):
        found += [m.span(1) for m in rx.finditer(line) if not harmless(m.group(1)) and (rx not in (_LOGIN, _SAID) or re.search(r"[0-9!$#%&@]", m.group(1)))]
    found += [m.span(1) for m in _WITH.finditer(line) if not harmless(m.group(1)) and re.search(r"[0-9!$#%&@]", m.group(1))]
    found += [m.span(m.lastindex) for m in _DASH.finditer(line) if not harmless(m.group(m.lastindex))]
    for m in _CALL.finditer(line):
        args = [a for a in _ARG.finditer(m.group(1))][1:]  # whom or where comes first
        found += [(m.start(1) + a.start(2), m.start(1) + a.end(2)) for a in args if _strong(a.group(2))]
    for rx in (_LITERAL, _FLAG):
        found += [m.span(2) for m in rx.finditer(line) if secret_name(m.group(1)) and not harmless(m.group(2))]
    pairs = [(m.group(2), m.end(), m.group(3)) for m in _PAIR.finditer(line)]
    if named and (m := _VALUE.match(line)):
        pairs.append((named, m.end(), ":"))
    for name, at, sign in pairs:
        if not secret_name(name):
            continue
        spans = _literal(line, at)
        if spans:
            v = "".join(line[a:b] for a, b in spans)
            if not harmless(v) and not (re.search(r"\s", v) and len(v) > 64):
                found += spans
        else:
            v = _bare(line[at:])
            # outside quotes a word of a program is a variable or a call
            if v and not harmless(v) and not _IDENT.match(v) or v and sign != ":" and re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", v) and re.search(r"\d", v) and not harmless(v):
                found.append((at, at + len(v)))
            elif v and not harmless(v) and re.search(r"[0-9]", v) and re.fullmatch(r"[A-Za-z0-9]{16,}", v) and _entropy(v) > 3:
                found.append((at, at + len(v)))
    return found


def _split_parts(line: str) -> list[tuple[int, int]]:
    """Spans of an issued token that is put together from string parts on one line."""
    out = []
    for m in re.finditer(r"[\"'`]\s*(?:\+|,)\s*[\"'`]", line):
        a = max(line.rfind(q, 0, m.start()) for q in "\"'`")
        b = min((k for q in "\"'`" if (k := line.find(q, m.end())) >= 0), default=-1)
        if a >= 0 and b > 0:
            v = line[a + 1 : m.start()] + line[m.end() : b]
            if (i := _ISSUED.search(v)) and not harmless(i.group()) or (j := _JWT.search(v)) and _jwt(j.group(1)):
                out += [(a + 1, m.start()), (m.end(), b)]
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def find_secrets(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line_no, start, end) of each secret in a text, by position. Lines count from 1 and end at ``\\n``."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts: list[int] = []
    last = -1
    for end, _ in auto.iter(low):
        if end > last:
            a = text.rfind("\n", 0, end) + 1
            last = text.find("\n", end)
            last = len(text) if last < 0 else last
            starts.append(a)
    if not starts:
        return []
    out, seen, line_no, counted = [], set(), 1, 0
    blocks = []
    for m in _PEM.finditer(text):
        if (b := _BODY.match(text, m.end())) and not _MASKED.match(b.group(1)) and not blanked(b.group(1)):
            e = _PEM_END.search(text, m.end())
            blocks.append((m.start(), e.end() if e else b.end(1)))
    for a in starts:
        line_no += text.count("\n", counted, a)
        counted = a
        for k in (0, 1):  # the line, and the next one for a name that stands alone
            b = text.find("\n", a)
            b = len(text) if b < 0 else b
            if k == 0:
                name = _NAMED.match(text[a:b].replace("\r", ""))
                if name and not secret_name(name.group(1)):
                    name = None
            if (a, bool(k and name)) not in seen and (k == 0 or name):
                seen.add((a, bool(k and name)))
                line = text[a:b]
                for s, e in {*_line_secrets(line, name.group(1) if k and name else None), *(_split_parts(line) if k == 0 else [])}:
                    if not any(x <= a + s < y for x, y in blocks):
                        out.append((line_no + k, a + s, a + e))
            a = b + 1
            if a > len(text):
                break
    out += [(text.count("\n", 0, x) + 1, x, y) for x, y in blocks]
    return sorted(set(out))


def scan(chunks: DataFrame) -> DataFrame:
    """(id, line_no, start, end_, verified): every secret of every chunk_text; offsets are code points, end_ is exclusive.

    A keyword automaton passes over each whole text; only lines with a keyword are matched against issuers' formats, key
    and value pairs, logins and headers, and what is found must be no placeholder, reference, pattern, hash or id, must
    decode where its format says so, or must hold a key body. Repeated rows give repeated rows here. Null and empty
    texts give none. ``verified`` says of tokens with a checksum whether it holds, null of all else; a token whose checksum
    does not hold is reported all the same, as issuers keep old formats valid. Only id and chunk_text are read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton()
        for f in frames:
            rows = [(i, *hit, verified(t[hit[1] : hit[2]])) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1]) if t for hit in find_secrets(t, auto)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "start", "end_", "verified"])

    return chunks.select("id", "chunk_text").mapInPandas(run, "id string, line_no int, start int, end_ int, verified boolean")


def secret_lines(chunks: DataFrame) -> DataFrame:
    """(id, line_no) of every line on which a secret begins, once."""
    return scan(chunks).select("id", "line_no").distinct()


#: Alphabets, the narrowest first, with what stands for a lower-case letter, a capital and a digit of each.
_ALPHABETS = (
    (re.compile(r"[\d\W_]*"), "", "", "0"),
    (re.compile(r"[0-9a-fA-F\W_]*"), "a", "A", "0"),
    (re.compile(r"[A-Z2-7\W_]*"), "", "Q", "2"),
    (re.compile(r"[1-9A-HJ-NP-Za-km-z]{25,}"), "q", "Q", "2"),
    (re.compile(r".*", re.S), "q", "Q", "0"),
)


def blank(value: str) -> str:
    """A placeholder of the same length and alphabet: a hexadecimal value stays one, base32, base58 and base64 likewise.

    An issuer's prefix and all marks stay where they are. A checksum within the value does not hold afterwards.
    """
    m = _PREFIX.match(value)
    keep = m.end() if m and m.end() < len(value) else 0
    body = value[keep:]
    low, up, digit = next(f[1:] for f in _ALPHABETS if f[0].fullmatch(body))
    return value[:keep] + "".join(digit if c.isdigit() else up if c.isupper() else low if c.isalpha() else c for c in body)


def blanked(value: str) -> bool:
    """Whether a value is a placeholder that :func:`blank` left."""
    m = _PREFIX.match(value)
    letters = {c for c in value[m.end() if m else 0 :] if c.isalnum()}
    return bool(letters) and (letters <= set("aA0") or letters <= set("qQ0") or letters <= set("qQ2"))


def base62(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def verified(token: str) -> bool | None:
    """Whether the checksum in an issued token holds; null where its format has none that is public.

    The last six characters of some formats are the CRC-32 of what lies between prefix and them, in base 62.
    """
    m = re.fullmatch(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})", token)
    if not m:
        return None
    return base62(zlib.crc32(m.group(1).encode())).rjust(6, "0") == m.group(2)


def redacted(text: str, auto: ahocorasick.Automaton) -> tuple[str, int]:
    """(text, secrets): the text with the secret values blanked out and everything else, markers of key blocks included, as it was."""
    out, done = [], 0
    found = find_secrets(text, auto)
    for _, a, b in sorted(found, key=lambda x: x[1:]):
        if b <= done:
            continue
        a = max(a, done)
        part = text[a:b]
        if "-----BEGIN" in part:
            bits = re.split(r"(-----[^-\n]+-----|\\[nr])", part)
            part = "".join(x if x.startswith(("-----", "\\")) else blank(x) for x in bits)
        else:
            part = blank(part)
        out += [text[done:a], part]
        done = b
    return "".join([*out, text[done:]]), len(found)


def redact(chunks: DataFrame) -> DataFrame:
    """(id, chunk_text, n_secrets): all rows, their secrets replaced; lengths, lines and quoting stay as they were.

    A row with a null text keeps it and has 0 secrets. Rows are neither dropped nor merged.
    """

    @F.pandas_udf("struct<text:string,n:int>")
    def clean(texts: pd.Series) -> pd.DataFrame:
        auto = _automaton()
        return pd.DataFrame([redacted(t, auto) if t else (t, 0) for t in texts], columns=["text", "n"])

    return chunks.select("id", clean("chunk_text").alias("r")).select("id", F.col("r.text").alias("chunk_text"), F.col("r.n").alias("n_secrets"))


def redact_once(chunks: DataFrame) -> DataFrame:
    """The rows of :func:`redact`, once an id; of unlike texts of one id the least.

    Only rows whose id is repeated are brought together; all others stay where they are read.
    """
    again = chunks.groupBy("id").count().filter("count > 1").select("id")
    if small_enough(again, 1_000_000):
        again = F.broadcast(again)
    same = F.col("id").eqNullSafe(F.col("again"))
    own, again = chunks.select("id", "chunk_text"), again.withColumnRenamed("id", "again")
    few = own.join(again, same, "left_semi").groupBy("id").agg(F.min("chunk_text").alias("chunk_text"))
    return redact(own.join(again, same, "left_anti").unionByName(few))
