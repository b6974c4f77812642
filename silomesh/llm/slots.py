"""Unresolved template slots and runs of dummy text.

A slot is a marker whose content names a field of a card (``{{ owner }}``, ``%%title%%``), an instruction to a writer
(``[Insert licence here]``, ``TODO: write owner``), a blank that was never filled (``?????``), dummy Latin, a word repeated
over and over, or keyboard rows.  Markers in quotation marks or backticks are talked about and don't count.  A marker whose
content is no known field is left open: its name and style are told, as a name that stands unresolved in several styles of
markers is a field, while a variable of code (``${BASE_DIR}``, ``{db_id}``) keeps the style of its language.  Markers of any
length are read.
"""

from __future__ import annotations

import re

#: The fields of a card, with "-" where words meet.
FIELDS = (
    "abstract column-list contact curator database-name date description download-size email first-column intro-text keywords "
    "last-update licence organisation owner period publisher region related-silos row-count sample-rows silo-title source-link "
    "steward summary table-count table-name title topic version your-name"
).split()

#: Words of dummy Latin.
LATIN = (
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore "
    "duis ea eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum "
    "lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt "
    "tempor ullamco ut velit veniam voluptate"
).split()

#: Keyboard rows and repeated dummy words.
KEYS = "asdf asdasd sdfg fghj hjkl jkl; qwerty qwertz uiop zxcv yxcv aaaa".split()
DUMMY = ["blah", "bla", "test", "dummy", "sample text", "text", "foo", "bar", "xyz", "lorem", "your text goes here", "filler", "example", "beispiel", "muster", "exemple", "ejemplo", "prueba", "texto", "texte"]

#: What stands before a field name, and what a template engine puts around it.
OWNERS = "silo item card".split()

#: Words of an instruction, before or after the field, in the languages of the records.
ASK_BEFORE = (
    "insert enter add type write put provide choose select give specify replace your the please here fill bitte hier ihr ihre ihren indiquez insérez insérer saisissez ajoutez "
    "entrez écrivez votre vos complétez renseignez insertar inserte escriba escribe indique añada añadir introduzca ponga complete completar su tu in le la les el los las"
).split()
ASK_AFTER = (
    "here goes comes to follow be added written filled in completed pending missing hier eintragen einfügen ergänzen einsetzen angeben ausfüllen folgt ici à a compléter remplir venir "
    "insérer ajouter préciser définir aquí por para completar definir rellenar escribir insertar"
).split()

#: Delimiters of markers; the flag tells that a bare field name is enough between them.
DELIMITERS = [
    (r"%%([^%\n]{2,})%%", True), (r"%\(([^()\n]{2,})\)[sd]\b", True), (r"\$\{([^{}\n]{2,})\}", True), (r"\$([A-Za-z_][A-Za-z0-9_.-]+)\$", True), (r"<%=?([^%\n]{2,})%>", True),
    (r"\{%([^%\n]{2,})%\}", True), (r"\{\{\{?([^{}\n]{2,})\}\}", True), (r"#\{([^{}\n]{2,})\}", True), (r"\{([^{}\n]{2,})\}", True), (r"<<([^<>\n]{2,})>>", True), (r"<([A-Za-zÀ-ÿ][^<>\n]{2,})>", True),
    (r"&lt;([^&\n]{2,})&gt;", True), (r"\[\[([^\[\]\n]{2,})\]\]", True), (r"@@([^@\n]{2,})@@", True), (r"__([A-Za-z][A-Za-z0-9_.-]*?[A-Za-z0-9])__", True), (r"##([A-Za-z_]{3,})##", True),
    (r"\[([^\[\]\n|]{3,})\]", False), (r"\(([^()\n]{3,})\)", False),
]

MARKER_RE = re.compile("|".join(d for d, _ in DELIMITERS))
_BARE = [b for _, b in DELIMITERS]
_FIELD_SET = {f.replace("-", "") for f in FIELDS}
_FIELD_SET |= {o + f for f in _FIELD_SET for o in OWNERS}
_BEFORE, _AFTER = set(ASK_BEFORE), set(ASK_AFTER)
_QUOTES = set("\"'`“”„«»")
_JINJA = re.compile(r"^\s*(?:if|for|include|unless)\b|\|.*$|['\"]", re.S)


def is_request(inner: str) -> bool:
    """Whether the content of a marker asks a writer for a card field."""
    words = re.findall(r"[^\W_]+", inner.lower())
    at, end = 0, len(words)
    while at < end and words[at] in _BEFORE:
        at += 1
    before, start_after = at, end
    while start_after > before and words[start_after - 1] in _AFTER:
        start_after -= 1
    return (before > 0 or start_after < end) and start_after > before and "".join(words[before:start_after]) in _FIELD_SET


_names = "|".join(f.replace("-", "[ _-]?") for f in FIELDS)
LOOSE = [
    rf"\b(?:TODO|FIXME|TBD|TBA|XXX)\b[:,]? ?(?:write |add |insert |fill in |complete )?(?:the )?(?:{_names})\b",
    rf"_{{3,}} ?\((?:{_names})[^()\n]*\)?",
    rf"\.{{3}} ?\((?:{_names})[^()\n]*\)?",
]
BLANKS = r"(?<![?\w])\?{4,}(?![?\w])|(?<![\w])X{4,}(?![\w])"
LOOSE_RE = re.compile("|".join(LOOSE), re.IGNORECASE)
_LOOSE_HINTS = ("TODO", "FIXME", "TBD", "TBA", "XXX", "___", "... (", "...(")
BLANK_RE = re.compile(BLANKS)

_latin = "|".join(sorted(LATIN, key=len, reverse=True))
_keys = "|".join(re.escape(k) for k in KEYS)
_dummy = "|".join(sorted(DUMMY, key=len, reverse=True))
LATIN_RE = re.compile(rf"(?<![\w])(?:{_latin})(?:[ ,.;]+(?:{_latin})\b){{4,}}", re.IGNORECASE)
KEYS_RE = re.compile(rf"(?<!\w)(?:{_keys})(?: (?:{_keys})){{2,}}", re.IGNORECASE)
DUMMY_RE = re.compile(rf"(?<!\w)({_dummy})(?:[ ,.;]+\1\b){{3,}}", re.IGNORECASE)
_LATIN_HINTS = [w for w in LATIN if len(w) > 4]
_PAGE_TITLE = re.compile(r"<title>[^<\n]*</title>", re.I)
_OPENERS = ("{", "<", "[", "(", "%", "$", "@@", "__", "##", "&lt;")
_NAME = re.compile(r"[A-Za-z][A-Za-z]*(?:[ _.-][A-Za-z]+){0,3}(?:[ _-]?\d{1,2})?")
MASK = "<SLOT>"


def field_name(inner: str) -> str:
    """The name in a marker, whatever its spelling."""
    inner = re.sub(r"[_ -]?\d{1,2}$", "", _JINJA.sub("", inner).strip())
    return re.sub(r"[^a-z]", "", inner.lower())


def mask_slots(text: str) -> tuple[str, bool, list[tuple[str, int]]]:
    """The text with ``MASK`` for every slot and run of dummy text, whether there is one, and the (name, style) of markers
    that are left open."""
    openers = [o for o in _OPENERS if o in text]
    open_markers: list[tuple[str, int]] = []
    any_slot = False
    if openers:
        if "<title>" in text:
            text = _PAGE_TITLE.sub(lambda m: m.group(0)[7:-8] + "\n", text)
        out, done, at = [], 0, 0
        while m := MARKER_RE.search(text, at):
            g = m.lastindex
            inner = m.group(g)
            quoted = m.start() > 0 and text[m.start() - 1] in _QUOTES
            if not quoted and ((_BARE[g - 1] and field_name(inner) in _FIELD_SET) or is_request(inner)):
                out += [text[done : m.start()], MASK]
                done = at = m.end()
                any_slot = True
                continue
            if not quoted and _BARE[g - 1] and _NAME.fullmatch(inner.strip()):
                open_markers.append((field_name(inner), g))
                quoted = True
            at = m.end() if quoted else m.start() + 1
        if out:
            text = "".join(out) + text[done:]
    rules = []
    if any(h in text for h in _LOOSE_HINTS):
        rules.append(LOOSE_RE)
    if "????" in text or "XXXX" in text:
        rules.append(BLANK_RE)
    low = text.lower()
    if any(h in low for h in _LATIN_HINTS):
        rules.append(LATIN_RE)
    if any(h in low for h in KEYS):
        rules.append(KEYS_RE)
    if any(low.count(h) > 3 for h in DUMMY):
        rules.append(DUMMY_RE)
    for rule in rules:
        text, n = rule.subn(MASK, text)
        any_slot |= n > 0
    return text, any_slot, open_markers


def slot(text: str) -> bool:
    """Whether a text has a slot or a run of dummy text."""
    return mask_slots(text)[1]
