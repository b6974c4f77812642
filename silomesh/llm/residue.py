"""Template residue and error-page text.

Texts are cut into segments (lines, sentences, menu items) whose slots, names, numbers and codes are masked.  Message
templates are mined from the distinct masked segments by a prefix tree of fixed depth: the number of words and the first
words of a segment lead to a leaf, and within a leaf a segment joins the first template that agrees with it in enough words.
A leaf is mined in parts, whose templates are then mined together, so it is no larger for one task when there is more text.

Each template is classified once, from two kinds of evidence, and its verdict holds for all its segments:

* what it says: general vocabulary of errors, script notices and filler, and the form of titles and menu items, suggest a
  class;
* where it stands: over all documents, how often it is part of a page that says little else.  A suggested message that mostly
  stands among ordinary sentences writes about errors and is content; a sentence of any wording that mostly stands on pages
  of messages is a foot line or a message itself; a sentence that mostly stands beside filler is filler, and filler that
  stands alone among ordinary sentences is a remark about filler.  A sentence that always has a slot in the same
  place talks about slots, while a slot where other records have a value is unresolved.

A text is a case if a slot of an ordinary template is unresolved in it, if it has filler, or if it has a message and
otherwise only titles, menus and foot lines.  Null and blank texts are no cases, repeated texts are judged alike, an empty
table has no cases, other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silomesh.llm.slots import MASK, mask_slots
from silomesh.operators.value_counts import digest
from silomesh.runtime import Workspace

DEPTH = 3  # words of a segment that lead to its leaf
AGREE = 0.75  # share of words in which a segment agrees with its template
PART = 2000  # distinct segments of a leaf that are mined together before their templates are
SPREAD = 4  # documents that a template must stand in to be judged by where it stands alone
PAGE = 0.4  # share of a page's segments, titles left out, that suggest a message
MOSTLY = 0.5  # share of a template's documents that decides
TALK = 6  # words of its own that a sentence about slots has
STYLES = 3  # styles of markers in which a name stands unresolved if it is a field

#: Foot lines in general use, by language.
FOOT = [
    r"(?:please )?try again(?: later)?", r"back to\b.*", r"contact\b.*", r"all rights\b.*", r".*\bcookies\b.*", r"please wait\W*", r"loading\W*", r"(?:reference|code|error code):? [\w<>]+", r"zur(?:ück)?\b.*", r"alle rechte\b.*", r"(?:bitte )?versuchen sie es später\b.*", r"kennung:? [\w<>]+",
    r"retour\b.*", r"tous droits\b.*", r"(?:veuillez )?réessaye[rz]\b.*", r"volver\b.*", r"todos los derechos\b.*", r"(?:por favor,? )?(?:inténtelo|intente|vuelva a intentarlo)\b.*", r"código:? [\w<>]+",
]

_SCRIPT = r"(?:java ?scripts?|ecma ?script|js|(?:active |browser )?script(?:s|ing| support|e)?|active content|aktive inhalte|skripte?)"
#: What error messages and notices say, by language.
MESSAGES = [
    r"\bhttp (?:status|error) (?:<n>|\d{3}\b)", r"\b(?:error|fehler|erreur)(?: code)? ?:? ?(?:<n>|\d{3}\b)", r"^\W*(?:<n>|\d{3}\b)[ :-]*(?:page|not|bad|service|internal|gateway|gone|forbidden|unauthori[sz]ed|too|request|seite|page|página)", r"\b(?:page )?not found\b", r"\bforbidden\b", r"\bbad gateway\b", r"\bgateway time-?out\b",
    r"\bservice (?:temporarily )?unavailable\b", r"\binternal server\b", r"^\W*(?:gone|unauthori[sz]ed|bad request|request time-?out|too many requests)\b", r"\baccess denied\b", r"\bauthorization required\b", r"\bpayment required\b", r"\bnot acceptable\b", r"\bnot implemented\b", r"\blog in again\b", r"\bwebsite is offline\b", r"\bout of service\b", r"\bcould not be (?:found|loaded|shown|reached|opened)\b", r"\boverloaded\b", r"\btook too long\b", r"\bran into a problem\b",
    r"\bserver fault\b", r"\b(?:has|have) been (?:removed|blocked|deleted|moved|suspended)\b", r"\bwas blocked\b", r"\b(?:does not|doesn't) exist(?: any ?more)?\b", r"\bcan(?:'t|not) (?:be shown|find|be found|be displayed)\b", r"\bfailed to load\b", r"\b(?:is )?(?:not|no longer) available\b", r"\bunexpected error\b",
    r"\bsomething went wrong\b", r"\bsession has expired\b", r"\btoo many requests\b", r"\bconnection to the \w+ failed\b", r"\bconnect failure\b", r"\bcould not complete\b", r"\btimed out\b", r"\bpermission to (?:view|see|open)\b", r"\b(?:is )?down for maintenance\b", r"\bunder maintenance\b", r"\btemporarily (?:down|offline|closed)\b",
    r"\b(?:konnte|konnten) nicht (?:geladen|gefunden|angezeigt)\b", r"\bnicht (?:gefunden|verfügbar|erreichbar)\b", r"\bwurde (?:gesperrt|entfernt|gelöscht|verschoben)\b", r"\bexistiert nicht mehr\b", r"\bgestört\b", r"\bserverfehler\b", r"\bschiefgegangen\b", r"\bunerwarteter fehler\b", r"\bzugriff verweigert\b", r"\büberlastet\b",
    r"\bzu viele anfragen\b", r"\bsitzung ist abgelaufen\b", r"\bkeine berechtigung\b", r"\bzeitüberschreitung\b", r"\bwartungsarbeiten\b", r"\bnicht (?:geöffnet|abgeschlossen) werden\b",
    r"\bintrouvable\b", r"\b(?:a|ont) été (?:retirée?s?|supprimée?s?|bloquée?s?|déplacée?s?)\b", r"\bn'existe plus\b", r"\berreur (?:interne|inattendue)\b", r"\baccès (?:refusé|interdit)\b", r"\bindisponible\b", r"\bn'est (?:pas|plus) disponible\b", r"\bn'a pas pu être\b", r"\bsurchargée?\b", r"\btrop de requêtes\b", r"\bsession a expiré\b", r"\bmal passé\b", r"\bdélai (?:d'attente )?dépassé\b", r"\ben maintenance\b",
    r"\bno encontrad[oa]\b", r"\bno se (?:encuentra|encontró)\b", r"\bcannot start\b", r"\bkann nicht starten\b", r"\bne peut pas démarrer\b", r"\bno puede (?:iniciar|arrancar)\b", r"\bno (?:se )?(?:pudo|ha podido|puede|pudieron) (?:cargar|mostrar|encontrar|abrir|completar)", r"\bya no existe\b", r"\b(?:ha sido|fue) (?:eliminad|retirad|bloquead|borrad|movid)[oa]\b", r"\berror (?:interno|inesperado)\b", r"\bacceso denegado\b", r"\bno está disponible\b", r"\bsobrecargad[oa]\b", r"\bdemasiadas (?:solicitudes|peticiones)\b", r"\bsesión ha (?:expirado|caducado)\b", r"\bsalió mal\b", r"\bmantenimiento\b", r"\bse produjo un error\b",
    rf"\b(?:enable|allow|permit|activate|need|needs|needed|requires?|without|disabled|blocked|necessary|turn(?:ed)? (?:it )?o(?:n|ff)|switch(?:ed)? o(?:n|ff)|appears)\b.*\b{_SCRIPT}\b|\b{_SCRIPT}\b.*\b(?:enabled?|disabled|needed|needs|required?|turned o(?:n|ff)|switched o(?:n|ff)|blocked|off|on|activated?|allowed)\b",
    r"\bbrowser blocked the code\b", r"\bchecking (?:your|this|the) browser\b", r"\bturn it on in (?:your|this) browser\b",
    rf"\b{_SCRIPT}\b.*\b(?:ausgeschaltet|eingeschaltet|deaktiviert|aktiviert|benötigt|nötig|erforderlich|sein|an|zulassen|erlauben)\b|\b(?:benötigt|aktivieren|ohne|erlauben|braucht|schalten)\b.*\b{_SCRIPT}\b",
    rf"\b{_SCRIPT}\b.*\b(?:désactivé|activé|nécessaire|requis|autorisé)\b|\b(?:nécessite|activez|activer|sans|autorisez|autoriser|requiert)\b.*\b{_SCRIPT}\b",
    rf"\b{_SCRIPT}\b.*\b(?:desactivad|activad|necesari|permitid)\w*\b|\b(?:necesita|activar|active|activa|sin|permita|habilite|requiere|habilitar)\b.*\b{_SCRIPT}\b",
]

#: Words for filler, by language, and what a sentence says that is filler.
_WORDS = r"(?:placeholder|dummy|filler|mock|sample|example|stand-?in|temporary)"
FILLER = [
    rf"\b{_WORDS} (?:text|content|wording|paragraph|copy|section|words)\b", r"\bis (?:only |just )?(?:a )?(?:placeholder|dummy|filler|mock|stand-?in|made up)\b", r"\bstands? in for\b", r"\bfills? (?:up )?(?:the )?(?:space|room)\b|\btakes? up (?:the )?(?:space|room)\b",
    r"\b(?:swapped|replaced?|changed|exchanged)\b.{0,}\b(?:real|true|final|actual)\b", r"\byour (?:text|content)\b.{0,}\bhere\b", r"\b(?:text|content|summary|description) (?:goes|comes|follows) here\b", r"\bwrite something\b", r"\bsome filler\b", r"\breplace this\b",
    r"\b(?:blind|füll|platzhalter|beispiel|muster)text\b", r"\bplatzhalter\b", r"\bdient nur dem layout\b", r"\bhier steht später\b",
    r"\btexto (?:de (?:relleno|prueba|ejemplo)|provisional|ficticio)\b", r"\bpárrafo (?:de (?:muestra|relleno|prueba)|provisional)\b", r"\baquí irá\b",
    r"\b(?:texte|paragraphe|contenu) (?:provisoire|factice|de remplissage|d'exemple)\b", r"\bviendra plus tard\b",
]

#: Parts of which every message holds one; a template without any is not tried against the patterns.
MESSAGE_HINTS = (
    "http", "error", "fehler", "erreur", "page", "not ", "bad", "service", "internal", "gateway", "gone", "forbidden", "unauthori", "unavailable", "too ", "request", "seite", "página", "denied", "required", "offline", "again", "could not", "overloaded", "problem",
    "fault", " been ", "was blocked", "exist", "can't", "cannot", "failed", "available", "went wrong", "expired", "connect", "timed out", "permission", "maintenance", "temporarily", "nicht", "wurde", "gestört", "schief", "zugriff", "überlast", "viele anfragen",
    "abgelaufen", "keine ", "zeitüber", "wartung", "introuvable", "été ", "n'existe", "accès", "disponible", "n'est", "n'a pas", "surcharg", "trop de", "expiré", "mal passé", "délai", "encontrad", " se ", "no pud", "no puede", "no ha pod", "ya no", "ha sido", "fue ",
    "acceso", "sobrecarg", "demasiadas", "sesión", "salió", "mantenimiento", "produjo", "script", "js", "active content", "aktive inhalte", "browser", "starten", "démarrer", "no se ", "not\t", "time-out", "timeout", "no carg", "no mostr",
)

#: Parts of which every filler sentence holds one.
FILLER_HINTS = (
    "placeholder", "dummy", "filler", "mock", "sample", "example", "stand", "temporary", "made up", "fill", "take", "swapped", "replace", "changed", "exchanged", "your text", "your content", " here", "write something", "text", "platzhalter", "layout", "steht später",
    "provisional", "ficticio", "muestra", "relleno", "prueba", "aquí irá", "provisoire", "factice", "remplissage", "exemple", "viendra plus tard",
)

_TAGS = re.compile(r"<hr>\s*<center>[^<]*</center>|</?(?:html|head|title|body|h[1-6]|noscript|center|hr|p|div|br|span|main|section)\b[^<>]*>", re.I)
#: Words that begin a sentence after a menu or a title that has no end mark.
_STARTERS = (
    "The|This|That|Your|You|An|A|We|We're|HTTP|Error|Request|Please|To|For|Before|Access|Back|Contact|All|Oops|Sorry|Too|Forbidden|Checking|Loading|Table preview|It|Page|Scripts?|Our|"
    "Die|Der|Das|Dieser?|Ihre?|Leider|Ein|Eine|Fehler|Seite nicht|Interner|Zugriff|Zur|Um|Bitte|Ohne|Zu|"
    "La|Le|Les|Cette|Ce|Votre|Une|Un|Erreur|Accès|Retour|Pour|Veuillez|Sans|El|Esta|Este|Su|Se|Página|Acceso|Volver|Para|Por|Sin|Demasiadas|Trop"
)
_START = re.compile(rf" (?<=[\w)!?.>] )(?=(?:{_STARTERS}) )| (?<=^[#=] <ID> )(?=[A-ZÀ-Ý])| (?<=^== <ID> )(?=[A-ZÀ-Ý])")
_CUT = re.compile(r"\n|\s+(?=##+ |== )|(?<=[.!?…])\s+| [|·>»•] | - (?=data card)")
_TIME = re.compile(r"^\s*\d\d:\d\d(?::\d\d)?\b", re.M)
_ID = re.compile(r"\b\w+_\w+\b|\b(?:[A-Z]?[a-z]+[A-Z]\w*)\b|\b\w+(?:\.\w+)+\b|\b\w+-\w+(?:-\w+)+\b")
_JS = re.compile(r"(?i)\b(?:java ?script|ecma ?script)\b")
_NUM = re.compile(r"\d\w*(?:[.,:]\d\w*)*")
_WORD, _MASKS = re.compile(r"\w"), re.compile(r"<[\w*]+>")
_FOOT = re.compile(r"\W*(?:" + "|".join(FOOT) + r")\W*", re.I)
_MESSAGE, _FILLER = re.compile("|".join(MESSAGES), re.I), re.compile("|".join(FILLER), re.I)
_TITLE = re.compile(r"^[#=*\s]*(?:<ID>|<N>|[^\W\d_][\w'’-]*)(?: (?:<ID>|<N>|[^\W\d_][\w'’-]*)){0,3}(?:[:\s]*|\.{3}|…)$")


_MASKED: dict[str, str] = {}


def _mask_word(word: str) -> str:
    """A word with its name or number replaced."""
    if len(_MASKED) > 500_000:
        _MASKED.clear()
    out = _MASKED[word] = _NUM.sub("<N>", _ID.sub("<ID>", word))
    return out


def segments(text: str) -> list[str]:
    """The masked segments of a text, in order."""
    s = _TIME.sub("<TIME>", text)
    if "cript" in s or "CRIPT" in s:
        s = _JS.sub("javascript", s)
    if "<" in s:
        s = _TAGS.sub("\n", s)
    s = "\n".join(" ".join([_MASKED.get(w) or _mask_word(w) for w in line.split()]) for line in s.split("\n"))
    return [m for piece in _CUT.split(s) for part in _START.split(piece) if (m := part.strip())]


def _hints() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in ((1, MESSAGE_HINTS), (2, FILLER_HINTS)):
        for w in words:
            found.add_word(w, found.get(w, 0) | kind)
    found.make_automaton()
    return found


_HINTS = _hints()


def classify(template: str) -> str:
    """The class that the words of a template suggest: message, frame (title, menu item, foot line), filler or content.

    A line of a log, which begins with a time, and a slot in words are content.
    """
    t = template.strip()
    if not _WORD.search(_MASKS.sub(" ", t)):
        return "frame"
    if t.startswith("<TIME>"):
        return "content"
    low = t.lower()
    hints = 0
    for _, kind in _HINTS.iter(low):
        hints |= kind
        if hints == 3:
            break
    if hints & 2 and _FILLER.search(low):
        return "filler"
    if _FOOT.fullmatch(t):
        return "frame"
    if hints & 1 and _MESSAGE.search(t):
        return "message"
    return "frame" if _TITLE.match(t) else "content"


def mine_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    """(masked, template) for the distinct masked segments of one leaf, the most frequent first."""
    pdf = pdf.sort_values(["n", "masked"], ascending=[False, True])
    words = [m.split() for m in pdf["masked"]]
    ids: dict[str, int] = {}
    grid = np.array([[ids.setdefault(w, len(ids) + 1) for w in ws] for ws in words], dtype=np.int64).reshape(len(words), -1)
    shapes = np.zeros((0, grid.shape[1]), dtype=np.int64)  # 0 = any word
    seen: list[list[str]] = []
    of = np.zeros(len(words), dtype=np.int64)
    need = AGREE * grid.shape[1]
    for i, row in enumerate(grid):
        if len(shapes):
            agree = (shapes == row).sum(1)
            best = int(agree.argmax())
            if agree[best] >= need:
                of[i] = best
                shapes[best] = np.where(shapes[best] == row, row, 0)
                continue
        of[i] = len(shapes)
        shapes = np.vstack([shapes, row])
        seen.append(words[i])
    texts = [" ".join(w if s else "<*>" for w, s in zip(ws, shape)) for ws, shape in zip(seen, shapes)]
    return pd.DataFrame({"masked": pdf["masked"].to_numpy(), "template": [texts[k] for k in of]})


def mine_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """``mine_leaf`` of each leaf part of a bucket; a segment that is alone in its part is its own template."""
    leaf = pdf.groupby(["size", "head", "part"], sort=False).ngroup().to_numpy()
    alone = np.bincount(leaf)[leaf] == 1
    single = pdf.loc[alone, "masked"]
    parts = [pd.DataFrame({"masked": single, "template": single})]
    rest, of = pdf.loc[~alone, ["masked", "n"]], leaf[~alone]
    order = np.argsort(of, kind="stable")
    ends = np.flatnonzero(np.diff(of[order])) + 1
    parts += [mine_leaf(rest.iloc[at]) for at in np.split(order, ends) if len(at)]
    return pd.concat(parts, ignore_index=True)


def _leaf(df: DataFrame) -> DataFrame:
    """``df`` with the path of ``masked`` through the prefix tree: its length and first words, masked ones as one branch."""
    words = F.split("masked", " ")
    head = F.array_join(F.transform(F.slice(words, 1, DEPTH), lambda w: F.when(w.startswith("<"), "<*>").otherwise(w)), " ")
    return df.withColumns({"size": F.size(words), "head": head})


def _mined(df: DataFrame, buckets: int) -> DataFrame:
    held = df.select(F.pmod(F.xxhash64("size", "head", "part"), F.lit(buckets)).alias("bucket"), "size", "head", "part", "masked", "n")
    return held.groupBy("bucket").applyInPandas(mine_bucket, "masked string, template string")


def mine_templates(work: Workspace, distinct: DataFrame, bucket: int = 20_000) -> DataFrame:
    """(masked, template) of distinct segments (masked, n); the leaves are worked on in buckets of about ``bucket`` segments."""
    placed = work.write(_leaf(distinct))
    crowded = placed.groupBy("size", "head").agg(F.count("*").alias("held")).filter(f"held > {PART}")
    cut = placed.join(crowded, ["size", "head"], "left").withColumn("part", F.pmod(F.xxhash64("masked"), F.coalesce(F.ceil(F.col("held") / PART), F.lit(1))).cast("int"))
    first = work.write(_mined(cut, max(1, -(-placed.count() // bucket))))
    shapes = first.join(placed, "masked").groupBy(F.col("template").alias("masked")).agg(F.sum("n").alias("n"))
    shapes = work.write(_leaf(shapes).withColumn("part", F.lit(0)))
    second = _mined(shapes, max(1, -(-shapes.count() // bucket))).filter("masked <> template")
    return first.join(second.select(F.col("masked").alias("template"), F.col("template").alias("whole")), "template", "left").select("masked", F.coalesce("whole", "template").alias("template"))


_SAID: dict[str, str] = {}


def _suggest(segment: str) -> str:
    if len(_SAID) > 200_000:
        _SAID.clear()
    out = _SAID[segment] = classify(segment)
    return out


#: Suggested classes as they are kept with a segment.
CLASSES = ("content", "frame", "message", "filler")


def _read_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text its different segments and their suggested classes, whether it reads like a page of messages, and how
    many of its segments suggest content and filler."""
    for b in batches:
        rows = []
        for t in b["txt"]:
            masked, _, left = mask_slots(t)
            segs = list(dict.fromkeys(segments(masked)))
            said = [_SAID.get(x) or _suggest(x) for x in segs]
            plain, messages, fillers = (said.count(c) for c in ("content", "message", "filler"))
            rows.append((segs, [CLASSES.index(c) for c in said], messages > 0 and messages >= PAGE * (messages + plain), plain, fillers, [{"name": n, "style": k} for n, k in left if n]))
        yield pd.DataFrame({"doc": b["doc"], **{n: [r[i] for r in rows] for i, n in enumerate(("segs", "said", "page", "plain", "fillers", "markers"))}})


def _needed(words: DataFrame) -> DataFrame:
    """The segments (masked, n) whose templates matter: those of every leaf that has a slot, a suggested message or filler,
    or a sentence that stands beside one."""
    placed = _leaf(words)
    asked = placed.filter(F.col("masked").contains(MASK) | F.col("said").isin(2, 3) | ((F.col("said") == 0) & ((F.col("n_pages") > 0) | (F.col("n_beside") > 0))))
    return placed.join(asked.select("size", "head").distinct(), ["size", "head"], "left_semi").select("masked", "n")


def find_residue(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, reason): texts with an unresolved slot or filler, and texts that are an error page or a script notice."""
    work = Workspace(documents.sparkSession, "residue")
    kind = dict(documents.dtypes)[doc]
    held = documents.filter(F.col(text).rlike(r"\S")).select(F.col(doc).alias("doc"), F.col(text).alias("txt"))
    parsed = work.write(held.mapInPandas(_read_texts, f"doc {kind}, segs array<string>, said array<int>, page boolean, plain int, fillers int, markers array<struct<name:string,style:int>>"))
    key = [h.alias(n) for h, n in zip(digest("masked"), ("h1", "h2"))]  # stands for a segment where its text isn't needed
    beside = F.col("fillers") > (F.col("said") == 3).cast("int")
    seen = parsed.select("doc", "page", "plain", "fillers", F.inline(F.arrays_zip("segs", "said"))).withColumnRenamed("segs", "masked")
    seen = seen.select("doc", "page", "plain", "said", beside.alias("beside"), "masked", *key)
    words = seen.groupBy("masked", "said").agg(F.count("*").alias("n"), F.count_if("page").alias("n_pages"), F.count_if("beside").alias("n_beside"))
    words = work.write(words.select("masked", *key, "said", "n", "n_pages", "n_beside"))
    mined = work.write(mine_templates(work, _needed(words)))

    # the class of a template is that of its most frequent segment
    told = mined.select(F.xxhash64("template").alias("template"), F.col("masked").contains(MASK).alias("has_slot"), F.size(F.filter(F.split("masked", " "), lambda w: ~w.contains("<"))).alias("words"), *key)
    told = work.write(told.join(words.select("h1", "h2", "said", "n"), ["h1", "h2"]))
    classes = told.groupBy("template").agg(F.max_by("said", F.struct("n", "h1", "h2")).alias("suggested"))
    of = work.write(told.join(classes, "template").select("h1", "h2", "template", "suggested", "has_slot", "words"))
    met = work.write(seen.drop("masked").join(of, ["h1", "h2"]).select("doc", "page", "plain", "said", "template", "suggested", "has_slot", "words", "beside"))
    once = met.groupBy("doc", "template").agg(F.max("page").alias("page"), F.max("beside").alias("beside"), F.max("has_slot").alias("has_slot"))
    known = once.groupBy("template").agg(F.count("*").alias("n_docs"), F.count_if("page").alias("n_pages"), F.count_if("beside").alias("n_beside"), F.count_if("has_slot").alias("n_slots"))

    spread, mostly = F.col("n_docs") >= SPREAD, lambda c: F.col(c) >= MOSTLY * F.col("n_docs")
    on_page, by_filler, suggested = mostly("n_pages"), mostly("n_beside"), F.col("suggested")
    verdict = (
        F.when(suggested == 2, F.when(on_page, "message").otherwise("content"))
        .when(suggested == 3, F.when(by_filler | ~spread | on_page, "filler").otherwise("content"))
        .when(suggested == 0, F.when(spread & by_filler, "filler").when(spread & on_page, "frame").otherwise("content"))
        .otherwise("frame")
    )
    talk = (F.col("n_slots") == F.col("n_docs")) & spread & (F.col("words") >= TALK)
    judged = met.join(known, "template").select("doc", "plain", "said", verdict.alias("verdict"), (F.col("has_slot") & ~talk).alias("slot"))
    freed, added = (F.col("said") == 0) & (F.col("verdict") != "content"), (F.col("said") != 0) & (F.col("verdict") == "content")
    by_doc = judged.groupBy("doc").agg(F.count_if("slot").alias("slots"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("message", "filler")), (F.max("plain") - F.count_if(freed) + F.count_if(added)).alias("content"))
    reason = F.when(F.col("slots") > 0, "slot").when(F.col("filler") > 0, "filler").when((F.col("message") > 0) & (F.col("content") == 0), "message")
    pages = by_doc.select("doc", reason.alias("reason")).filter("reason is not null")
    markers = parsed.select("doc", F.inline("markers"))
    fields = markers.groupBy("name").agg(F.count_distinct("style").alias("styles"), F.count_distinct("doc").alias("docs")).filter(f"styles >= {STYLES} and docs >= {SPREAD}")
    named = markers.join(fields, "name").select("doc", F.lit("slot").alias("reason"))
    return pages.unionByName(named).groupBy("doc").agg(F.max("reason").alias("reason")).select(F.col("doc").alias(doc), "reason")
