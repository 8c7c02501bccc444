"""Template residue, filler, error-page text and demands for scripts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = r"[A-Za-z][A-Za-z0-9_]*(?: [A-Za-z][A-Za-z0-9_]*){0,3}"
TAGS = r"(?!/?(?:a|b|i|p|u|br|em|hr|li|ol|ul|td|th|tr|div|pre|sub|sup|img|html|body|head|span|code|table|strong|noscript|h[0-9])\b)"

#: The ways a template marks a slot, by name. Only one that was never filled still stands in a text.
SLOTS = {
    "mustache": r"\{\{[^{}\n]{0,80}\}\}",
    "directive": r"\{%[^%\n]{0,80}%\}",
    "tagged": r"<%[^%\n]{0,80}%>",
    "dollar": r"\$\{[^{}\n]{1,80}\}",
    "dollars": r"\$\$" + FIELD + r"\$\$",
    "ats": "@@" + FIELD + "@@",
    "hashes": r"(?<![\w#])##?" + FIELD + r"##?(?![\w#])",
    "underscored": r"(?<![A-Za-z0-9])__" + r"[A-Za-z](?:[A-Za-z0-9 ]|_(?!_)){0,40}" + r"__(?![A-Za-z0-9])",
    "percents": r"(?<![\w%])%" + FIELD + r"%(?![\w%])",
    "doubled": r"\[\[[^\[\]\n]{0,80}\]\]",
    "guillemets": "<<" + FIELD + ">>|«" + FIELD + "»",
    "asked": r"(?i:\[(?:insert|enter|select|choose|fill in|add|type|put|paste|write|your)\b[^\[\]\n]{0,80}\])",
    "pending": r"(?i:\[[^\[\]\n]{0,60}(?:to be completed|to be added|to come|tbd|tbc)\s*\])",
    "going": r"(?i:<[a-z][\w ]{0,40} (?:goes )?here>)",
    "told": r"(?i:<(?:insert|enter|select|choose|fill in|add|type|put|paste|write|your) [^<>\n]{1,60}>)",
    "added": r"(?i:\((?:add|insert|enter|fill in) [a-z_]+(?: [a-z_]+)?\))",
    "escaped": "&lt;" + TAGS + FIELD + "&gt;",
    "numbered": r"(?<![\^_\w\\{$])\{[0-9]{1,2}\}(?!\})",
    "braced": r"(?<![\^_\w\\{$])\{[A-Za-z][A-Za-z0-9_]+(?: [A-Za-z0-9_]+){0,3}\}(?!\})",
    "empty": r"(?<![\w\])}\\])(?:\[\s*\]|\{\s*\}|\[\?+\]|\[\.\.\]|\[…\])(?![\w(\[{])",
    "blank": r"(?<=[^\n_])_{3,}(?!_)|^_{3,}(?=[ \t]*[^\s_])",
    "crosses": r"(?<![\w.])X{2,}(?:\.X+)?(?![\w])",
}
UNITS = r"(?:mg|kg|g|mcg|µg|ml|mL|L|mmol|mEq|mmHg|cm|m|h|hours?|days?|weeks?|minutes?|min|percent|per|Stunden|heures|horas|%)"
VOID = r"(?:undefined|null|NULL|NaN|nan|None|NoneType)"
#: How a program's word for nothing stands where a value should.
VOIDS = "|".join([
    r"\[object Object\]", r"\bInvalid Date\b", r"#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!)", r"\bNaN\b",
    rf"\b{VOID}\s?{UNITS}(?![A-Za-z])",
    rf"[:=]\s*(?:undefined|null|NaN|nan|NoneType)\s*(?=[.,;)\n]|$)",
    rf"\b{VOID}\s+{VOID}\b",
    rf"\b(?:Dear|Hello|Hi|Bonjour|Estimad[oa](?:/a)?|Sehr geehrte(?:/r)?) {VOID}\b",
    r"\b(?:of|over|with|by|to|at|in) (?:undefined|NaN|null) (?:over|of|mg|in|for|every)\b",
])

WHAT = r"(?:javascript|client[- ]side scripts?|scripts|scripting|active (?:content|scripting)|cookies|skripte|les scripts|los scripts)"
ALLOW = r"(?:enabl|turn(?:ed)? on|switch(?:ed)? on|activat|allow|permit|requir|need|must be|accept|habilit|aktivier|benötig|nécessit|activ|to be on)"
OFF = r"(?:is|are|seems?|appears?)(?: to be)? (?:off|disabled|blocked|turned off|switched off|not enabled|deactivated)|(?:does not|doesn't|do not|cannot) (?:support|run)"
#: A demand to allow scripts or cookies; the plain noun script (a prescription) is none.
DEMANDS = "|".join([
    rf"(?i:\b{ALLOW}[^.!?\n]{{0,60}}\b{WHAT}\b)", rf"(?i:\b{WHAT}\b[^.!?\n]{{0,60}}(?:\b{ALLOW}|{OFF}))", rf"(?i:(?:{OFF})[^.!?\n]{{0,40}}\b{WHAT}\b)",
])

REASON = r"(?:not found|page not found|forbidden|bad gateway|gateway time-?out|internal (?:server )?error|service (?:temporarily )?unavailable|unauthori[sz]ed|bad request|gone|request time-?out|too many requests|access denied|method not allowed|server error)"
#: Messages of a server or viewer, and what such pages say next to them.
MESSAGES = "|".join([
    rf"(?i:\b[45][0-9]{{2}}\b\W{{0,4}}{REASON}\b)", rf"(?i:\b{REASON}\W{{1,3}}[45][0-9]{{2}}\b)",
    r"(?i:\b(?:error|fehler|erreur|http(?: status)?|status)\s*:?\s*[45][0-9]{2}\b\s*[:\-–])",
    r"(?i:(?:page|url|document|file|resource)s? (?:you (?:requested|are looking for|were looking for)|requested)[^.\n]{0,20}(?:not|n't|could))",
    r"(?i:angeforderte seite wurde nicht gefunden|page demandée est introuvable|(?:no se encontró la )?página solicitada)",
    r"(?i:interner serverfehler|erreur interne du serveur|error interno del servidor)",
    r"(?i:that page can(?:'|’)?t be found|page (?:cannot|could not|can't) be (?:found|displayed|loaded))",
    r"(?i:something went wrong on our end|an unexpected error (?:has )?occurred)",
    r"(?i:your session has (?:expired|timed out)|sitzung ist abgelaufen|session a expiré|sesión ha (?:caducado|expirado))",
    r"(?i:viewer failed to load|failed to load (?:this|the) (?:file|document|page|pdf)|document unavailable|may have been moved or deleted)",
    r"(?i:traceback \(most recent call last\)|fatal error: |uncaught (?:type|reference)error|call to undefined function|stack trace:)",
    r"(?i:(?:^|[.!?>\n])\s*(?:the )?request timed out\s*[.!<]?)", r"(?i:server is undergoing maintenance|site is (?:down|under) (?:for )?maintenance)",
    r"(?i:have permission to (?:view|access) this (?:resource|page|site))", r"(?i:verify (?:that )?you are (?:a )?human)",
    r"(?i:address may have been mistyped|contact the site administrator)", r"(?i:(?:^|[.!?>\n])\s*(?:please )?try again later)", r"(?i:slow down and retry)",
    r"(?i:(?:^|[.!?>\n])\s*loading\s*(?:\.\.\.|…))", r"(?i:if nothing happens, )",
    r"(?i:please sign in again to continue|bitte neu anmelden|veuillez vous reconnecter|inicie sesión de nuevo)",
])

LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "nulla tellus fuga porta congue ligare sedare mollit aptent vox rutilus odio ferri item nisi velit quam"
)
ASK = r"(?:insert|add|type|write|put|paste|enter|place)"
#: Filler in place of writing.
FILLERS = "|".join([
    rf"(?i:\b{ASK} (?:your |the |some )?(?:own )?(?:content|text|abstract|caption|summary|title|heading|body copy|body|copy|description|details|\w+ advice|\w+ copy) (?:here|later)\b)",
    rf"(?i:[\[<*]\s*{ASK} (?:your |the )?(?:content|text|abstract|caption|summary|title|heading|body copy|copy|description|\w+ advice)\s*[\]>*])",
    r"(?i:\b(?:sample|dummy|filler|placeholder|your|body) (?:text|copy|title|heading|content)(?: goes)? (?:here|for layout)\b)",
    r"(?i:\bfiller (?:copy|text)\b|\bcontent coming soon\b|\breplace this (?:paragraph|text)\b|\bthis (?:page|section) (?:is )?intentionally left blank\b|\bcoming soon\s*$)",
    r"\bTODO\b:?|\bFIXME\b|\bTBD\b", r"(?i:\btodo: \w+)",
    r"(?i:blindtext|platzhaltertext|inhalt folgt|hier steht (?:noch|ihr) \w*text)",
    r"(?i:texte de remplissage|contenu à venir|votre (?:titre|texte) ici)", r"(?i:contenido próximamente|texto de relleno|escriba aquí su texto|su (?:título|texto) aquí)",
    r"(?i:\b(\w+)(?: \1\b){2,})", r"(?i:\btest test\b)", r"(?i:\basdf\b|\bqwer(?:ty)?\b|\bjkl\b)", r"(?i:\bx{2,4}(?: x{2,4}){2,})",
    rf"(?i:(?:\b(?:{'|'.join(LATIN.split())})\b[\s,.;]*){{4,}})",
])

CHECKS = {k: re.compile(v, re.M) for k, v in {"slot": "|".join([*SLOTS.values(), VOIDS]), "filler": FILLERS, "message": MESSAGES, "demand": DEMANDS}.items()}

#: An order to write something, left standing where the writing should be.
VERBS = ("insert", "add", "type", "write", "put", "paste", "enter", "place")
THINGS = ("content", "text", "abstract", "caption", "summary", "title", "heading", "body", "copy", "description", "details", "advice")
VOID_WORDS = ("undefined", "null", "NaN", "None", "NoneType")
UNIT_WORDS = ("mg", "kg", "g", "mcg", "µg", "ml", "L", "mmol", "mEq", "mmHg", "cm", "m", "h", "hour", "hours", "day", "days", "week", "weeks", "minute", "minutes", "min", "percent", "per", "Stunden", "heures", "horas")
REASONS = (
    "not found", "forbidden", "bad gateway", "gateway timeout", "gateway time-out", "internal error", "internal server error", "service unavailable", "unauthorized", "unauthorised",
    "bad request", "gone", "request timeout", "request time-out", "too many requests", "access denied", "method not allowed", "server error",
)
#: Labelled exemplars of residue.
EXEMPLARS = [
    *[("slot", s) for s in (
        "{{name}}", "{% if name %}", "<%= name %>", "${name}", "$$name$$", "@@name@@", "#name#", "__name__", "%name%", "[[name]]", "<<name>>",
        "[INSERT name HERE]", "[name - to be completed]", "<name goes here>", "<put name>", "(add name)", "&lt;name&gt;", "at {0}", "{name}",
        "[ ]", "at ____", "XX", "name: [TBD]", "[object Object]", "Invalid Date", "NaN hours", "null mg", "undefined mg", "None mg", "nan mg", "Dear null", "Route: undefined.",
        "null null", "of null over", "Value: null.", "None kg",
    )],
    *[("filler", s) for s in (
        LATIN, "Insert content here.", "Insert your text here", "Sample text goes here.", "Your heading here", "Write abstract later!", "Type summary here.",
        "Add caption here.", "Paste body copy here.", "Put dosing advice here", "*** paste dosing advice ***", "<type abstract>", "[put summary]", "[insert text]",
        "<add caption>", "[write title]", "[enter details]", "Content coming soon", "Filler copy for layout only.", "Replace this paragraph with your own words.",
        "This page intentionally left blank.", "TODO: write section.", "TBD", "FIXME", "Hier steht noch Blindtext.", "Platzhaltertext, bitte ersetzen.", "Inhalt folgt in Kürze.",
        "Texte de remplissage à remplacer.", "Contenu à venir.", "Votre titre ici", "Contenido próximamente.", "Texto de relleno, sustituir más tarde.", "Escriba aquí su texto",
        "Text text text text", "test test test", "asdf qwer jkl", "xxx xxx xxx xxxx xx", "placeholder text", "dummy text", "lorem ipsum",
    )],
    *[("filler", f"{verb} {thing}") for verb in VERBS for thing in THINGS],
    *[("message", s) for s in (
        "404 Not Found", "403 Forbidden", "502 Bad Gateway", "504 Gateway Timeout", "500 Internal Server Error", "Internal error", "503 Service Temporarily Unavailable",
        "Service unavailable", "401 Unauthorized", "400 Bad Request", "410 Gone", "408 Request Timeout", "429 Too Many Requests", "Access denied", "Error 404: page not found",
        "Server said 404 (Gone)", "Status: 404", "HTTP 404", "Error 404:", "The page you requested could not be found.", "That page can't be found.", "Fehler 404: Die angeforderte Seite wurde nicht gefunden.",
        "Erreur 404 : la page demandée est introuvable.", "Error 404: no se encontró la página solicitada.", "Interner Serverfehler", "Erreur interne du serveur", "Error interno del servidor",
        "Sorry, something went wrong on our end.", "An unexpected error occurred", "Your session has expired.", "Please sign in again to continue.", "Ihre Sitzung ist abgelaufen, bitte neu anmelden.",
        "Votre session a expiré, veuillez vous reconnecter.", "Su sesión ha caducado, inicie sesión de nuevo.", "The document viewer failed to load this file.", "Document unavailable.",
        "It may have been moved or deleted.", "Traceback (most recent call last)", "Fatal error: call to undefined function", "Request timed out.", "The server is undergoing maintenance.",
        "You don't have permission to view this resource.", "Verify you are human", "The address may have been mistyped.", "Contact the site administrator.", "Please try again later.",
        "Slow down and retry.", "Loading...", "If nothing happens,",
    )],
    *[("demand", s) for s in (
        "Please enable JavaScript to view this page.", "JavaScript is disabled in your browser.", "You need to enable JavaScript to run this app.", "Your browser does not support scripts",
        "Scripts must be switched on", "This site requires cookies and scripts to work properly.", "turn on scripts", "permit scripts", "We need scripts to be on", "it looks as if JavaScript is off", "it looks as if active content is off", "cookies must be allowed", "Please switch on scripting in your browser",
        "active content must be allowed", "activate active scripting", "client-side scripts is off", "Diese Anwendung benötigt JavaScript und Cookies.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
        "Veuillez activer JavaScript pour afficher cette page.", "Ce site nécessite l'activation des scripts.", "Active JavaScript para ver esta página.", "Este sitio necesita que los scripts estén habilitados.",
        "Please accept cookies", "cookies are blocked",
    )],
    # The words no match of an alternative of the exact checks can do without, each set as an exemplar of its own:
    # a window with a match covers it whole, so the check is called whatever the weights are.
    *[("slot", s) for s in ("{0}", " ____", "#REF!", *VOID_WORDS, *(v + u for v in VOID_WORDS for u in UNIT_WORDS))],
    *[("filler", f"{kind} {thing}") for kind in ("sample", "dummy", "filler", "placeholder", "your", "body") for thing in ("text", "copy", "title", "heading", "content")],
    *[("filler", s) for s in (
        "replace this paragraph", "replace this text", "intentionally left blank", "coming soon", "TODO", "Blindtext", "Blindtexte", "Blindtextes", "Blindtexten", "Platzhaltertext", "Platzhaltertexte",
        "Platzhaltertextes", "Platzhaltertexten", "Inhalt folgt", "steht noch", "steht Ihr", "texte de remplissage", "contenu à venir", "votre titre ici", "votre texte ici", "contenido próximamente",
        "texto de relleno", "escriba aquí su texto", "su título aquí", "su texto aquí", "test", "asdf", "qwer", "qwerty", "jkl", "xx", "xxx", "xxxx",
    )],
    *[("message", f"404 {reason}") for reason in REASONS],
    *[("message", f"{word} 404") for word in ("error", "Fehler", "Erreur", "HTTP", "status")],
    *[("message", s) for s in (
        "requested", "you are looking for", "you were looking for", "angeforderte Seite wurde nicht gefunden", "page demandée est introuvable", "página solicitada", "that page cant be found",
        "page cannot be", "page could not be", "page can't be", "something went wrong on our end", "unexpected error occurred", "your session has expired", "your session has timed out",
        "Sitzung ist abgelaufen", "session a expiré", "sesión ha caducado", "sesión ha expirado", "failed to load", "been moved or deleted", "Fatal error", "Uncaught TypeError", "Uncaught ReferenceError",
        "call to undefined function", "Stack trace", "server is undergoing maintenance", "site is down maintenance", "site is under maintenance", "permission to view this", "permission to access this",
        "address may have been mistyped", "try again later", "sign in again to continue", "bitte neu anmelden", "veuillez vous reconnecter", "inicie sesión de nuevo",
    )],
    *[("demand", s) for s in ("JavaScript", "scripts", "scripting", "cookies", "Skripte", "active content", "client-side script")],
]
#: Words of filler that are everyday words too, so common that texts are not scanned for them alone.
EVERYDAY = ("et", "do")
FILLER_RUN = 4

#: Words come first, as most of a text is words; the marks are tried only where one of their first characters stands.
_SCAN = re.compile(
    r"(?!XX)(?P<word>[^\W\d_]+)|(?=[{<\[(&_X%#$@«.…45])(?:"
    + "|".join(f"(?P<{name}>{pattern})" for name, pattern in SLOTS.items())
    + r"|(?P<sheet>#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!))|(?P<code>(?:\b|(?i:(?<=error)|(?<=fehler)|(?<=erreur)|(?<=http)|(?<=status)))[45][0-9]{2}\b)|(?P<dots>\.\.\.|…)|(?P<rest>[^\W\d_]+))",
    re.M,
)


#: What must stand in a text for any mark of ``_SCAN`` to be found; for the JVM's regular expressions.
MARKS = (
    r"(?=[{<\[$@#%«_X&.…(45])(?:[{<\[$@#%«…]|__|XX|&lt;|\.\.\.|\((?i:add|insert|enter|fill)"
    r"|\b[45][0-9]{2}\b(?=\W{0,4}[A-Za-z])|(?<=[A-Za-z)]\W{0,3})[45][0-9]{2}\b)"
)

#: A run of everyday filler words, for which no text leaves the JVM otherwise.
EVERYDAY_RUN = rf"\b(?:{'|'.join(EVERYDAY)})\b(?:[\s,.;]+(?:{'|'.join(EVERYDAY)})\b){{{FILLER_RUN - 1}}}"


def words_of(text: Column) -> Column:
    """The words of a text in lower case, as an array: every run of letters, also inside marks."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def terms(text: str) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of a text: words in lower case, slot marks by their kind, codes of errors as one."""
    for m in _SCAN.finditer(text):
        kind = m.lastgroup
        yield (m.group().lower() if kind in ("word", "rest") else f"\u00a7{kind}"), m.start(), m.end()


#: Words that stand inside a slot mark are read as part of it; words of an exemplar count once.
VOCABULARY = sorted({t for _, text in EXEMPLARS for t, _, _ in terms(text)})
FILLER_WORDS = frozenset(LATIN.split())


class ResidueIndex:
    """Exemplars under an inverted index of their terms, weighted by the corpus."""

    def __init__(self, weights: dict[str, float], containment: float):
        self.weights = weights
        self.exemplars: list[tuple[str, frozenset[str], float, int]] = []
        self.postings: dict[str, list[int]] = {}
        for family, text in EXEMPLARS:
            bag = frozenset(t for t, _, _ in terms(text))
            total = sum(weights[t] for t in bag)
            if text == LATIN:
                bag_need = total * 0.06  # a window of filler is made of a few of these words
            else:
                bag_need = total * containment
            i = len(self.exemplars)
            self.exemplars.append((family, bag, bag_need, max(8, 2 * len(bag))))
            rest = total
            # Without one of these terms the rest cannot reach the containment.
            for t in sorted(bag, key=lambda t: (-weights[t], t)):
                if rest < bag_need:
                    break
                self.postings.setdefault(t, []).append(i)
                rest -= weights[t]
        self.words = sorted({t for t in self.postings if not t.startswith("\u00a7")} | FILLER_WORDS.difference(EVERYDAY))

    def matches(self, text: str, reach: int = 120) -> bool:
        """Whether a window of the text covers an exemplar enough and its exact check agrees."""
        stream = list(terms(text))
        known = [(k, t) for k, (t, _, _) in enumerate(stream) if t in self.weights]
        tried: set[tuple[str, int]] = set()
        run, last = 0, -2
        for n, (k, t) in enumerate(known):
            if t in FILLER_WORDS:
                run, last = (run + 1 if k == last + 1 else 1), k
                if run >= FILLER_RUN and self.agrees("filler", text, stream[k], reach):
                    return True
            for i in self.postings.get(t, ()):
                family, bag, need, width = self.exemplars[i]
                if (family, k) in tried:
                    continue
                found = {t} if t in bag else set()
                for step in (1, -1):
                    m = n + step
                    while 0 <= m < len(known) and abs(known[m][0] - k) <= width:
                        if known[m][1] in bag:
                            found.add(known[m][1])
                        m += step
                if sum(self.weights[x] for x in found) < need:
                    continue
                tried.add((family, k))
                if self.agrees(family, text, stream[k], reach):
                    return True
        return False

    @staticmethod
    def agrees(family: str, text: str, at: tuple[str, int, int], reach: int) -> bool:
        """Whether the family's exact check finds something around the term ``at``."""
        low, high = max(0, at[1] - reach), min(len(text), at[2] + reach)
        # What ends at the window's end is looked at again in the whole text.
        return any(m.end() > m.start() and (m.end() < high or CHECKS[family].match(text, m.start())) for m in CHECKS[family].finditer(text, low, high))


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """In how many texts each term of the exemplars stands: (term, n). Term ``""`` counts all texts.

    Words are counted in the JVM; only texts in which a mark may stand are scanned in Python.
    """
    plain = [t for t in VOCABULARY if not t.startswith("\u00a7")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, sums = frozenset(VOCABULARY) - frozenset(plain), {}
        for batch in batches:
            for value in batch["t"]:
                for t in {t for t, _, _ in terms(value)} & wanted:
                    sums[t] = sums.get(t, 0) + 1
        yield pd.DataFrame({"term": list(sums), "n": list(sums.values())}).astype({"term": object, "n": "int64"})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    found = F.concat(F.array(F.lit("")), F.array_intersect(words_of(F.col("t")), F.lit(plain)))
    words = rows.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    marks = rows.where(F.col("t").rlike(MARKS)).mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return words.unionByName(marks)


def residue(docs: DataFrame, doc_id: str, text: str, containment: float = 0.55) -> DataFrame:
    """``doc_id`` and whether the text holds residue: a bare slot, filler, a message or a demand.

    The labelled exemplars lie under an inverted index by their rarest terms, weighted by inverse
    document frequency over all texts. Wherever such a term stands, the window around it is compared:
    if it covers ``containment`` of an exemplar's weight, an exact check of the exemplar's family
    decides there. Every alternative of the checks has an exemplar of the words it cannot do
    without, so the index finds what the checks alone would find; but a word said three times
    counts as filler only near an exemplar's word, else any stammer would. Whole texts are read. Null and blank texts hold none; repeated texts and ids give
    repeated rows; an empty table gives an empty table. What goes to the driver are the counts of
    the exemplars' terms, a few hundred at any size; nothing is shuffled but those.
    """
    counts = {r["term"]: r["n"] for r in document_counts(docs, text).collect()}
    n = counts.get("", 0)
    weights = {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 0.05 for t in VOCABULARY}

    index = ResidueIndex(weights, containment)
    # A text without a word of any posting and without a mark can't be met; it doesn't leave the JVM.
    may = F.lower(text).rlike(EVERYDAY_RUN) | F.col(text).rlike(MARKS) | F.arrays_overlap(words_of(F.col(text)), F.lit(index.words))

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bool(t) and index.matches(t) for t in batch], dtype=bool)

    return docs.select(doc_id, F.coalesce(holds(F.when(may, F.col(text))), F.lit(False)).alias("is_residue"))
