"""Template residue, filler and error pages that stand where content should be."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import cut, salted_join

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTED = re.compile(r"[\"“”«»„]([^\"“”«»„\n]{1,200})[\"“”«»„]")

#: First words of tags, so that they are not taken for a template's angle brackets.
HTML_TAGS = frozenset("a abbr article aside audio b base body br button canvas caption cite code col details div dl dt em embed fieldset figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label legend li link main map mark meta nav object ol option p param path pre q s script section select small source span strong style sub sup svg table tbody td template textarea tfoot th thead title tr u ul var video".split())
#: Forms of an unfilled slot, each behind strings of which one must stand in the text.
SLOTS = (
    (("{{",), r"\{\{[#/^>&!~-]?\s*[A-Za-z_][^{}\n]{0,80}\}\}"),
    (("${",), r"\$\{[A-Za-z_][\w.\[\]-]*\}"),
    (("<%",), r"<%[=#-]?[^%\n]{1,120}%>"),
    (("{%",), r"\{%-?\s*[a-z]+\b[^%\n]{0,120}%\}"),
    (("[",), r"\[(?:INSERT|ENTER|ADD|YOUR|FILL|TODO|TBD|PLACEHOLDER|NAME|DATE|TITLE|COMPANY|AUTHOR|XXX?)(?:[ _:-][^\]\n]{0,60})?\](?!\()"),
    (("[",), r"\[(?:[Ll]ist|[Nn]ame|[Ll]ink|[Dd]escribe|[Ii]nsert|[Ee]nter|[Aa]dd|[Yy]our|[Dd]ate|[Tt]itle|[Ss]ummary|[Oo]wner|[Ee]xplain|[Ff]ill|[Ww]rite|[Rr]eplace) (?:[^\]\n]{2,80})\](?!\()"),
    (("<",), r"<(?:[A-ZÄÖÜÉÈÑ][A-ZÄÖÜÉÈÑ0-9]+)(?:[ _-][A-ZÄÖÜÉÈÑ0-9a-z]+)+>"),
    (("<",), r"<(?:YOUR|INSERT|NAME|TITLE|DATE|TODO|COMPANY|AUTHOR)[A-Z0-9_ -]*>"),
    (("###",), r"#{3}[A-Za-z_]{2,40}#{3}"),
    (("@",), r"@@[\w.-]{2,60}@@|(?<!\w)@[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+@"),
    (("%(", "%%"), r"%\([A-Za-z_]\w*\)[sdifr]|%%[A-Za-z_]{2,40}%%"),
    (("{",), r"(?<![\w$\\{}])\{\d{1,2}\}(?!\})"),
    (("TODO", "FIXME"), r"(?:^|\n|[.!?]\s)[\s>*#-]*(?:TODO|FIXME)\s*:\s*\S"),
    ((" here)",), r"\((?:insert|add|put|place|enter) [^()\n]{3,80}? here\)"),
    (("YYYY-", "JJJJ-", "AAAA-"), r"(?:^|\n|[.!?]\s)[\s>*#-]*(?:Date|Datum|Fecha)\s*:\s*(?:YYYY|JJJJ|AAAA)-(?:MM)-(?:DD|TT|JJ)\b"),
)
_SLOTS = [(marks, re.compile(form)) for marks, form in SLOTS]
_ANGLE = re.compile(r"<([a-z]+)((?: [a-z]+){1,10})>")
_BROKEN = re.compile(r":\s*(?:undefined|null|None|NaN)\b[^.\n]{0,80}\[object Object\]|\[object Object\][^.\n]{0,40}\bNaN\b")
#: Words of filler Latin and of keyboards, and lines that only stand in for text.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
MASH = frozenset("asdf asdfg asdfgh asdfasdf qwer qwert qwerty qwertz azerty blah bla foo bar baz qux quux test testing xxx xyz abc hjkl jkl zxcv lalala".split())
STUBS = (
    "tbd", "tbc", "tba", "todo", "to do", "to be done", "to be added", "to be completed", "to be written", "to be defined", "coming soon", "work in progress", "under construction", "n/a yet",
    "write a short summary here", "write something here", "write your text here", "add text here", "add a description here", "add content here", "enter text here", "insert text here", "your text here", "your content here", "text here", "content here", "text goes here", "sample text", "sample text goes here", "sample text here", "dummy text", "placeholder", "placeholder text",
    "description to be added", "description goes here", "description here", "add description", "replace this paragraph with your own words", "replace this text", "replace me", "replace this paragraph", "replace this with your own text", "this page intentionally left blank", "this page is a stub",
    "text folgt", "inhalt folgt", "beschreibung folgt", "hier steht text", "hier könnte ihr text stehen", "platzhalter", "platzhaltertext", "beispieltext", "mustertext", "blindtext", "in arbeit", "im aufbau",
    "texte à venir", "texte a venir", "à compléter", "a compléter", "à venir", "à définir", "contenu à venir", "votre texte ici", "texte d'exemple", "description à ajouter", "en construction", "en cours de rédaction",
    "texto de ejemplo", "texto aquí", "su texto aquí", "tu texto aquí", "próximamente", "por completar", "pendiente", "por definir", "contenido pendiente", "en construcción", "descripción pendiente",
)
_STUBS = frozenset(STUBS)
_STATUS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|payload too large|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|error)"
#: What servers, gates and pages that need scripts say, one pattern a kind of message.
MESSAGES = (
    rf"<title>[^<]*\b[45]\d\d\b[^<]*</title>|^\W*(?:http(?:/\d(?:\.\d)?)?\s*)?(?:error\s*)?[45]\d\d\b\W*(?:{_STATUS})?\W*$|^\W*http(?:/[\d.]+)? [45]\d\d\b|^\W*(?:error|fehler|erreur)\W*[45]\d\d\b",
    rf"^\W*{_STATUS}\W*(?:\(?[45]\d\d\)?)?\W*$",
    r"^\W*(?:oops|sorry|uh[- ]oh|whoops|hoppla|ups)\b",
    r"(?:page|resource|file|url|address|document|site|requested \w+)\b.{0,80}\b(?:could not be (?:located|found)|cannot be found|was not found|not found on this server|no longer exists?|does not exist|has moved or never existed|doesn't exist)",
    r"^\W*(?:the )?(?:page|resource) has moved",
    r"seite (?:wurde )?nicht gefunden|angeforderte (?:adresse|seite|url)|existiert nicht \(mehr\)|page (?:introuvable|non trouvée)|cette page n'existe|no se encontr[óo] la página|página no (?:encontrada|existe)|la page (?:demandée|que vous)",
    r"^\W*(?:return|back|go back) to the (?:start|home|main|front) ?page|^\W*retour à l'accueil|^\W*zurück zur startseite|^\W*volver (?:al inicio|a la página)",
    r"something went wrong|an? (?:internal|unexpected|unknown) (?:server )?error (?:has )?(?:occurred|happened)|error interno|erreur interne|interner (?:server)?fehler|ein fehler ist aufgetreten|se ha producido un error|une erreur (?:interne )?est survenue|ha ocurrido un error",
    r"^\W*(?:please )?(?:try again|come back|retry|reload)\b.{0,30}(?:later|\d+ (?:minutes?|seconds?)|moment)|vuelva a intentarlo|réessayez|veuillez réessayer|versuchen sie es (?:später|erneut)|bitte später",
    r"(?:unable|failed|could not|cannot|can't) to? ?connect to (?:the )?(?:database|server|host|backend|upstream)|error establishing a database connection|connection (?:refused|reset|timed out)",
    r"^\W*file \"[^\"]+\", line \d+|^\W*[\w.]*(?:error|exception)\b\s*:|^\s*at [\w.$<>]+\([^)]*\)|^\W*(?:fatal|uncaught|unhandled|traceback)\b.{0,12}[:(]|^\W*\{?\s*\"?(?:error|errors|status|code)\"?\s*:\s*[\{\[\"\d]",
    r"got no answer from (?:the )?upstream|upstream (?:server|connect) (?:error|timed out)|no healthy upstream",
    r"(?:derzeit|momentan|vorübergehend) nicht (?:verfügbar|erreichbar)|temporairement indisponible|(?:temporalmente|actualmente) no (?:está )?disponible|is (?:temporarily|currently) (?:unavailable|down)|down for maintenance|wartungsarbeiten",
    r"^\W*access (?:is |was |has been )?(?:denied|blocked|forbidden)|you (?:do not|don't) have (?:permission|access)|you are not (?:allowed|authori[sz]ed)|not authori[sz]ed to|acc[eè]s refusé|acceso denegado|zugriff verweigert|keine berechtigung|permission denied|no tiene(?:s)? permiso|vous n'avez pas (?:l'autorisation|accès)",
    r"if this keeps happening|contact (?:the )?(?:operators?|administrators?|support|webmaster)\b.{0,60}\b(?:quote|mention|code|reference)|^\W*(?:request|reference|référence|referencia|vorgang|incident|trace|ray|código|code|error|support)\s*(?:id|number|nr\.?|no\.?|#|:)*\s*#?[0-9a-f-]{8,}\W*$",
    r"(?:enable|turn on|activate|allow|switch on|requires?|needs?)\b.{0,30}\b(?:java ?script|scripts?|scripting|cookies)\b|\bwithout (?:java ?script|scripts|scripting|cookies)\b|(?:java ?script|scripts?|scripting)\b.{0,30}\b(?:is|are)\b.{0,12}\b(?:off|disabled|required|blocked|needed)|does not run scripts|activez (?:le )?javascript|javascript (?:einschalten|aktivieren|ist deaktiviert|doit être|est requis|activado|desactivado)|(?:active|habilite|activa|habilita) (?:el )?javascript|aktivieren sie (?:bitte )?javascript|scripts? to load",
    r"check(?:ing)? (?:that|if) (?:you are|you're|the site connection)|verify(?:ing)? (?:that )?you are (?:a )?human|are you a (?:human|robot)|reviews the security of your connection|security of your connection|one more step|captcha|unusual traffic|ddos protection",
    r"rate limit(?:ed)? exceeded|too many (?:requests|attempts)|quota exceeded|session (?:has )?expired|please (?:log|sign) in to continue",
    r"^\W*\S+ loading\s*(?:\.\.\.|…)\W*$|^\W*loading\s*(?:\.\.\.|…)?\W*$|nothing rendered|template \S+ missing",
)
_MESSAGES = [re.compile(m, re.I) for m in MESSAGES]
#: Parts of words of which at least one stands in every message above that has no status number.
HINTS = (
    "error", "fehler", "erreur", "found", "gone", "conflict", "request", "payment", "payload", "forbidden", "acceptable", "gateway", "unavailable", "implemented", "not allowed", "authori", "located", "longer exist", "exist",
    "moved", "oops", "sorry", "uh-oh", "uh oh", "whoops", "hoppla", "ups", "seite", "page", "página", "accueil", "startseite", "inicio", "wrong", "moment", "try again", "come back", "retry", "reload", "intentarlo", "essayez",
    "später", "connect", "traceback", "exception", "fatal", "uncaught", "unhandled", "file \"", "status", "code", "upstream", "verfügbar", "erreichbar", "indisponible", "disponible", "down", "wartung", "denied", "blocked",
    "permission", "have access", "acceso", "acces", "accès", "zugriff", "berechtigung", "permiso", "autorisation", "keeps happening", "contact", "reference", "référence", "referencia", "vorgang", "incident", "trace", "ray", "código", "support",
    "script", "cookies", "human", "robot", "security", "captcha", "traffic", "ddos", "one more step", "check", "verify", "rate limit", "too many", "quota", "session", "sign in", "log in", "loading", "rendered", "missing", "unable to", "failed to", "could not", "cannot", "can't",
)
_CODE = re.compile(r"\b[45]\d\d\b")
_WEAK = re.compile(r"\b(?:error|fehler|erreur|page|seite|página|found|access|acceso|accès|zugriff|script\w*|javascript|browser|navegador|navigateur|server|servidor|serveur|request|permission|available|verfügbar|disponible|denied|blocked|expired|timeout|security|human|connection|maintenance|reload|retry)\b", re.I)
_HOST = re.compile(r"\b[a-z0-9-]+(?:\.[a-z0-9-]+){1,4}\b(?:/\S*)?", re.I)
_HEX = re.compile(r"\b[0-9a-f]{6,}\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Words of a sentence that may lie outside the message it holds: with more of them it tells about the message.
REST = 9
_BLOCK = re.compile(r"<(script|style|head|noscript)\b(?!.*<title).*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: A frame of a stack trace, and with it the line of program text below it.
_FRAME = re.compile(r"^[ \t]*(?:File \"[^\"\n]+\", line \d+[^\n]*\n(?:[ \t]+[^\n]*(?:\n|$))?|at [\w.$<>/]+\([^)\n]*\)[^\n]*(?:\n|$)|\.{3} \d+ more[^\n]*(?:\n|$))", re.M)


def prose(text: str) -> str:
    """The text without byte-order marks, invisible characters and code, fenced or inline; line ends are ``\\n``."""
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    return _INLINE.sub(" ", t) if "`" in t else t


def placeholder(t: str) -> bool:
    """Whether an unfilled slot or a value that a template printed broken stands in the prose ``t``."""
    maybe = [form for marks, form in _SLOTS if any(m in t for m in marks)]
    if not maybe:
        return "[object" in t and bool(_BROKEN.search(t))
    bare = _QUOTED.sub(" ", t)
    if any(form.search(bare) for form in maybe) or "[object" in t and _BROKEN.search(bare):
        return True
    return "<" in t and any(m.group(1) not in HTML_TAGS for m in _ANGLE.finditer(bare))


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    """Finds whether any stub, any two keyboard words or any long word of filler Latin occurs in a lower-case text."""
    a = ahocorasick.Automaton()
    for w in [*STUBS, *(f"{x} {y}" for x in MASH for y in MASH), *(w for w in LATIN if len(w) > 4)]:
        a.add_word(w, 1)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _message_hints() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in HINTS:
        a.add_word(w, 1)
    a.make_automaton()
    return a


def filler(t: str) -> bool:
    """Whether a run of filler Latin, a line of keyboard words or a line that only stands in for text is in ``t``."""
    low = t.lower()
    if next(_hints().iter(low), None) is None:
        return False
    for line in t.split("\n"):
        line = line.strip().strip("#>*-|_ \t").strip()
        if not line:
            continue
        words = _WORD.findall(line.lower())
        if len(words) >= 3 and all(w in MASH for w in words):
            return True
        run = 0
        for w in words:
            run = run + 1 if w in LATIN else 0
            if run >= 8:
                return True
        for s in re.split(r"(?<=[.!…])\s+", line):
            if len(s) < 80 and s.lower().strip(" .…!()[]*_:").strip() in _STUBS:
                return True
    return False


def visible(t: str) -> str:
    """What a reader of a page sees: its title on a line of its own, then the text without tags, scripts and styles."""
    if "<" not in t:
        return t
    title = " ".join(_TITLE.findall(t))
    body = _TAG.sub("\n", _BLOCK.sub("\n", _TITLE.sub(" ", t)))
    return f"{title}\n{body}" if title.strip() else body


def sentences(t: str) -> list[str]:
    return [x for line in t.split("\n") for x in re.split(r"(?<=[.!?])\s+", line) if _WORD.search(x) or re.search(r"\d", x)]


def is_message(sentence: str) -> bool:
    """Whether a sentence is a message of a server or gate, and does not only tell about one.

    Quoted words are not the sentence's own; of the rest no more than REST words may lie outside what the forms match.
    """
    s = _QUOTED.sub(" ", sentence) if not sentence.lstrip().startswith(("{", "File")) else sentence
    spans = sorted(m.span() for form in _MESSAGES for m in form.finditer(s))
    if not spans:
        return False
    rest, end = [], 0
    for a, b in spans:
        rest.append(s[end:a] if a > end else " ")
        end = max(end, b)
    return len(_WORD.findall(_HOST.sub(" ", " ".join([*rest, s[end:]])))) <= REST


def response(t: str) -> tuple[bool, bool]:
    """(is a message, might be one): whether at least half of the sentences of a text are what servers and gates say.

    Texts of any length are judged by what is visible of them: tags, scripts, styles and the frames of a stack trace are
    neither for nor against. A title of a few words says nothing either. A text that might be one is of low information:
    one of its sentences is a message, or it has three sentences at most and a word that messages are made of.
    """
    trace = ('", line ' in t or " at " in t or "\tat " in t or t.startswith("at ")) and bool(_FRAME.search(t))
    told = sentences(visible(_FRAME.sub("", t) if trace else t))
    if not told:
        return trace, trace
    need = (len(told) - 1) / 2 - len(_CODE.findall(t))
    if not trace and need > 0 and (len(told) > 3 or not _WEAK.search(t)):
        # less than half of the sentences can be messages
        if sum(1 for _ in islice(_message_hints().iter(t.lower()), math.ceil(need))) < need:
            return False, False
    hits = [is_message(x) for x in told]
    n, k = len(told), sum(hits) + trace
    if not hits[0] and n > 1 and len(_WORD.findall(told[0])) <= 6:
        n -= 1
    return bool(k) and 2 * k >= n + trace, bool(k) or (n <= 3 and bool(_WEAK.search(t)))


def hash_of(t: str) -> int:
    return xxhash.xxh64_intdigest(t) - (1 << 63)


def skeleton(t: str) -> int:
    """A hash of a response without what changes from copy to copy: hosts, paths, numbers, references and its first title."""
    s = _HEX.sub("0", _HOST.sub("h", t.lower()))
    s = re.sub(r"\d+", "0", s)
    return hash_of(" ".join(_WORD.findall(s)))


def terms(text: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(_HOST.sub(" ", text))}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, host, slug, slot, message, mismatch, skel, body) of the texts that show anything at all.

    ``slot``: 1 an unfilled placeholder, 2 filler, 0 neither. ``message``: at least half of it is what servers say; else it
    is of low information and might be. ``mismatch``: no term of its address (the last part of source_path) stands in its
    title, the first line that has words, or in its body. ``skel`` and ``body`` are hashes of its wording and its text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text, host, path in f.itertuples(index=False):
                if not text or not text.strip():
                    continue
                t = prose(text)
                if not t.strip():
                    continue
                slot = 1 if placeholder(t) else 2 if filler(t) else 0
                sure, maybe = (False, False) if slot else response(t)
                if not slot and not maybe:
                    continue
                slug = terms((path or "").rsplit("/", 1)[-1].rsplit(".", 1)[0])
                title = next((x for x in visible(t).split("\n") if _WORD.search(x)), "") if maybe else ""
                miss = maybe and not slug & terms(title) and not slug & terms(t)
                rows.append((doc, host, hash_of(" ".join(sorted(slug))), slot, sure, miss, skeleton(t) if maybe else 0, hash_of(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "host", "slug", "slot", "message", "mismatch", "skel", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text", F.col("source").cast("string"), F.col("source_path").cast("string"))
    return own.mapInPandas(run, f"doc_id {kind}, host string, slug long, slot int, message boolean, mismatch boolean, skel long, body long")


def residue(docs: DataFrame, copies: int = 3) -> DataFrame:
    """(doc_id, reason): documents to exclude, once each, by the first reason that holds.

    ``placeholder`` and ``filler``: such a thing stands in the text. ``duplicate``: a response that names no term of its
    own address, and of whose wording, apart from hosts, paths, numbers and references, there are ``copies`` unlike texts
    at ``copies`` unlike addresses, from at least two hosts or all from the one host there is. ``mismatch``: a message by
    its own sentences that names no term of its address. ``message``: one that names some.
    Code, quoted messages and sentences about messages are no evidence. Null, empty and blank texts give no row. Texts are
    read once; only what they show is kept, and counted by wording before it is joined, so one host or wording may hold any share of the rows.
    """
    f = cut(features(docs))
    low = f.filter("slot = 0 AND mismatch").select("skel", "body", "host", "slug").distinct()
    same = low.groupBy("skel").agg(F.count_distinct("body").alias("texts"), F.count_distinct("slug").alias("slugs"), F.count_distinct("host").alias("hosts"))
    hosts = f.agg(F.count_distinct("host").alias("every"))
    same = same.crossJoin(F.broadcast(hosts)).filter((F.col("texts") >= copies) & (F.col("slugs") >= copies) & ((F.col("hosts") >= 2) | (F.col("every") < 2))).select("skel", F.lit(True).alias("again"))
    j = salted_join(f, same, "skel", "left")
    reason = (
        F.when(F.col("slot") == 1, "placeholder").when(F.col("slot") == 2, "filler")
        .when(F.col("again") & F.col("mismatch"), "duplicate").when(F.col("message") & F.col("mismatch"), "mismatch").when(F.col("message"), "message")
    )
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("doc_id").agg(F.min("reason").alias("reason"))
