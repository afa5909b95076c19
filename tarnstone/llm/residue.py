"""Template residue, filler, error pages and scripts-required notices in place of content (problem 10).

Three kinds of evidence are combined for each document:

* detectors: unfilled template fields (delimiters around an identifier or a field word), filler (phrases, and runs of the
  words that filler generators draw from), error pages and scripts-required notices, looked for in what remains of the
  text after quoted and code passages are taken out (a text that explains a placeholder quotes it);
* comparison of terms: does the body use any word of the title or of the address slug (the last part of the source)? A
  body of few words that uses none and joins the notions of such a notice (a page and its absence, a failure and a
  status, scripts and switching them on), in whatever wording, counts;
* host evidence: how many documents, under how many titles and sources, carry the same body once case, digits and page
  furniture are masked. A body of few words, at odds with the titles of nearly all documents that carry it, that many
  titles of several sources share and that has one such notion is the response of a machine.

Only a fingerprint and the counts are shuffled, never the texts; the counts are combined on the map side, so a body
that a third of all documents share is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The written forms of unfilled template fields.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\$\{[^{}\n]{1,60}\}",
    r"#\{\s*[a-z_][\w. ]{0,40}\}",
    r"<%[=-]?[^%\n]{1,60}%>",
    r"\{%[^%{}\n]{1,60}%\}",
    r"<<[^<>\n]{1,40}>>",
    r"\[\[[^\[\]\n]{1,40}\]\]",
    r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%",
    r"\$[A-Z][A-Z0-9_]{2,}\$",
    r"(?<![\w`])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w`])",
    r"\bTODO_[A-Z_]+_HERE\b",
    r"(?iu)\{\s*(?:insert|enter|your|add|fill in)\b[^{}\n]{0,40}\}",
    r"(?iu)\[\s*(?:insert|enter|your|add|fill in|placeholder|name|insérer|votre|insertar|inserte|tu|su|nombre del?|hier|bitte)\b[^\[\]\n]{0,40}\](?!\()",
    r"(?<![\w%$({,\"'])\{\d\}(?![\w\"')}])",
    r"[\[<]\p{Lu}[\p{Lu}\d]*(?:_[\p{Lu}\d]+)+[\]>](?!\()",
    r"\[\p{Lu}+(?: \p{Lu}+){0,3} (?:NAME|DATE|TITLE|EMAIL|ADDRESS|COMPANY|NUMBER|HERE|NOMBRE|FECHA|NOM|DATUM|EMPRESA|ADRESSE)\](?!\()",
    r"(?<![\w$%/{(=,:\"'`])\{[a-z]+(?:_[a-z0-9]+)+\}(?![\w/}\"'`)])",
)
# Words that filler generators draw from and that no other language has as a common word.
FILLER_WORDS = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore aliqua enim veniam nostrud ullamco laboris aliquip commodo consequat "
    "aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum "
    "etiam nullam morbi cursus porta vestibulum pellentesque praesent curabitur vivamus mauris donec phasellus aenean fusce suspendisse vulputate"
)
# Filler phrases.
FILLER = (
    r"(?iu)\blorem ipsum\b",
    r"(?imu)^\W*(?:sample text|text goes here|placeholder paragraph|content goes here|your (?:text|content) (?:goes )?here)\b",
    r"(?iu)\badd a description for this project\b",
    r"(?iu)\bheading 1 heading 2\b",
    r"(?iu)\bclick to (?:edit|add text)\b",
    r"(?iu)\bbeispieltext, bitte ersetzen\b",
    r"(?iu)\btexte d['’]exemple à remplacer\b",
    r"(?iu)\btexto de (?:ejemplo|muestra|relleno)\b",
    r"(?iu)\b(?:asdf|qwer|qwerty)\b(?:\s+\b(?:asdf|qwer|qwerty)\b)+",
    r"(?iu)\bx{3,}(?:\s+x{3,}){1,}\b",
    r"(?iu)\btest test test\b",
)
# Phrases of error pages.
ERRORS = (
    r"(?iu)\b(?:http (?:error|status) ?)?(?:40[0-9]|41[0-9]|429|50[0-9])\s*(?:[|:–-]\s*)?(?:not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|interner serverfehler|seite nicht gefunden)",
    r"(?iu)\bthe page you (?:asked for|requested|are looking for) (?:could not be|cannot be|was not) found",
    r"(?iu)\bservice temporarily unavailable\b",
    r"(?iu)\bpage introuvable\b",
    r"(?iu)\bseite nicht gefunden\b",
    r"(?iu)\bp[áa]gina no encontrada\b",
    r"(?iu)\binterner serverfehler\b",
    r"(?iu)\berror interno del servidor\b",
    r"(?iu)\berreur interne du serveur\b",
    r"(?imu)(?:^|>)\W*access denied\b",
    r"(?iu)\byour session has expired\b",
    r"(?iu)\bthis content is no longer available\b",
    r"(?iu)\bthe requested note was deleted or never existed\b",
    r"(?iu)\btoo many requests\. slow down\b",
    r"(?iu)\bwe are checking your browser\b",
    r"(?iu)\bthe server met an unexpected condition\b",
    r"(?iu)\bfatal error: uncaught exception\b",
    r"(?iu)\bupstream request timeout\b",
    r"(?iu)\bdatabase connection failed\b",
    r"(?iu)\boops! something went wrong\b",
)
# Fixed value: an error object on a line of its own, whatever quotation marks it has.
ERROR_OBJECT = r"(?imu)^\s*(?:<[^<>\n]{0,40}>\s*)*\{\s*\"error\"\s*:"
# Phrases of scripts-required notices.
SCRIPTS = (
    r"(?iu)\bjavascript is (?:disabled|required|turned off)\b",
    r"(?iu)\b(?:enable|activate|turn on) (?:javascript|scripts)\b",
    r"(?iu)\brequires? javascript\b",
    r"(?iu)\bdoes not support scripts\b",
    r"(?iu)\bnoscript: ",
    r"(?iu)\bonly works with scripting switched on\b",
    r"(?iu)\baktivieren sie javascript\b",
    r"(?iu)\bactiver javascript\b",
    r"(?iu)\bactiv[ae] javascript\b",
)
# Notions of a notice, of which two must meet in one sentence of a body of few words.
PAGE = r"(?:page|site|website|board|note|document|resource|content|article|link|url|address|view|seite|inhalt|dokument|adresse|contenu|ressource|lien|p[áa]gina|recurso|contenido|enlace|sitio)"
ABSENT = (
    r"(?:(?:could|can|was|were|is|are|has|have|does|do|did)\s*n(?:o|['’])t\s+(?:be\s+|been\s+)?(?:found|located|exist|displayed|available|reachable|loaded|opened|here)|cannot be (?:found|located|displayed|loaded|opened|reached)"
    r"|(?:couldn|can|didn)['’]?t (?:find|locate|load|open|display)|unable to (?:find|locate|load|open|display)|no longer (?:exists?|available|here)|does(?:n['’]t| not) exist|(?:has|have) (?:moved|vanished|been (?:moved|removed|deleted))|(?:moved|vanished)[.!]"
    r"|existiert nicht|nicht (?:mehr )?(?:gefunden|verfügbar|erreichbar|vorhanden)|n['’](?:existe|est) (?:pas|plus)|introuvable|supprimée?|no (?:existe|se encuentra|se encontró|está disponible|fue encontrad[oa])|ya no (?:existe|está))"
)
STATUS = r"(?:http(?:/\d(?:\.\d)?)?|error|status|code|fehler|erreur|c[óo]digo)\W{0,3}(?:code\W{0,3}|status\W{0,3})?[45]\d\d|^\W*[45]\d\d\s*[|:–-]?\s*\p{Lu}[\p{L}' -]{2,30}\W*$"
FAULT = r"(?:(?:something|a problem|an? (?:unexpected|internal|unknown|server) error|an error)\b.{0,30}\b(?:wrong|occurred|happened|broke)|(?:request|session|connection|gateway|upstream)\s(?:has\s)?timed?[ -]?out|under maintenance|temporarily (?:down|offline)|try (?:again|later)|(?:not|n['’]t) (?:authori[sz]ed|permitted|allowed)|no permission|please (?:log|sign) in|(?:sign|log) in (?:again|to)|versuchen sie es später|réessayez|inténtelo|vuelva a intentar)"
SCRIPTING = r"(?:java\s?script|js\b|scripts?|scripting|skripte?|scripting)"
SWITCHED = r"\b(?:enabl|disabl|activ|aktivier|turn(?:ed)? (?:it |them )?o(?:n|ff)|switch(?:ed)? (?:it |them )?o(?:n|ff)|block|requir|need|without|support|allow|eingeschaltet|ausgeschaltet|benötig|nécessi|habilit|permit|desactiv|désactiv|necesit)"
BROWSER = r"\b(?:browser|page|site|app\b|board|view|content|continue|reload|navigat|seite|navegador|p[áa]gina|anzuzeigen|afficher|continuar|fortzufahren)"
NOTICES = tuple(
    rf"(?imu){x}"
    for x in (
        rf"\b{PAGE}\b[^.!?\n]{{0,60}}{ABSENT}", rf"{ABSENT}[^.!?\n]{{0,40}}\b{PAGE}\b", STATUS, rf"\b{FAULT}",
        rf"java\s?script[^.!?\n]{{0,60}}{SWITCHED}", rf"{SWITCHED}[^.!?\n]{{0,40}}java\s?script",
        rf"(?:\A|[.!?\n])(?=[^.!?\n]*{SWITCHED})(?=[^.!?\n]*{BROWSER})[^.!?\n]*\b{SCRIPTING}",
    )
)
#: One of them is enough in a response that many documents of a host share.
NOTION = rf"(?iu)\b(?:{PAGE}|{ABSENT}|{FAULT}|java\s?script|noscript|scripting|error|fehler|erreur|request|server|servidor|serveur|permission|denied|forbidden|unavailable|expired|placeholder|sign in|log ?(?:in|out)|retry|loading|redirect\w*|cookies?|captcha)\b"
# Page furniture: elements in lower case (fields in angle brackets are in upper case), as breaks of a line.
MARKUP = r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>"
# What marks a passage as quoted: code fences, inline code, and quotation marks of several scripts.
QUOTES = (
    r"(?s)```.*?(?:```|\z)",
    r"`[^`\n]{0,200}`",
    r"(?<![\w\"])\"[^\"]{1,300}\"(?!\w)",
    r"(?<![\w'])'[^']{1,300}'(?!\w)",
    r"“[^”]{1,300}”",
    r"„[^“”]{1,300}[“”]",
    r"‘[^’]{1,300}’",
    r"«[^»]{1,300}»",
)
#: Words up to which a body is low in information.
LOW_WORDS = 40

# What a text in lower case must contain for any pattern of a kind to match: plain searches that spare most texts the
# patterns. A new pattern needs its literal here.
GUARDS = {
    PLACEHOLDERS: ("{", "[", "<%", "<<", "%", "$", "__", "todo_"),
    FILLER: ("lorem ipsum", "sample text", "goes here", "placeholder paragraph", "your text", "your content", "add a description", "heading 1", "click to", "beispieltext", "texte d", "texto de", "asdf", "qwer", "xxx", "test test"),
    ERRORS: (
        "not found", "forbidden", "unauthorized", "bad request", "bad gateway", "gateway time", "server error", "unavailable", "too many requests", "serverfehler",
        "nicht gefunden", "be found", "page introuvable", "gina no encontrada", "erreur interne", "error interno", "access denied", "session has expired",
        "no longer available", "never existed", "checking your browser", "unexpected condition", "uncaught exception", "upstream request", "connection failed", "something went wrong",
    ),
    SCRIPTS: ("javascript", "scripts", "noscript", "scripting"),
}


def _by_letters(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that most words of a text fail at the first letters."""
    if len(words) == 1:
        return words[0]
    heads = sorted({w[:1] for w in words})
    return "(?:" + "|".join(h + _by_letters(sorted({w[1:] for w in words if w[:1] == h})) if h else "" for h in sorted(heads, reverse=True)) + ")"


#: What is counted to spare most texts the run: cheaper, and as often in a text as filler words are behind another sign.
FILLER_HINT = rf"[^a-z]{_by_letters(FILLER_WORDS.split())}"
FILLER_WORD = rf"\b{_by_letters(FILLER_WORDS.split())}\b"
#: Four filler words with at most four others between two of them.
FILLER_RUN = rf"(?:{FILLER_WORD}(?:[^\p{{L}}]++\p{{L}}++){{0,4}}?[^\p{{L}}]++){{3}}{FILLER_WORD}"


def guarded(low: Column, text: Column, kind: tuple[str, ...]) -> Column:
    """Does any pattern of a kind match the text?"""
    # one small expression for all literals: a long chain makes the generated method too big to be compiled
    may = F.exists(F.array(*map(F.lit, GUARDS[kind])), lambda literal: F.contains(low, literal))
    return may & text.rlike(any_of(kind))


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def with_bare(rows: DataFrame, wanted: Column) -> DataFrame:
    """Adds ``bare``, where ``wanted``: the text with markup and quoted passages taken out, except where a quotation or a
    JSON body is all there is. Each step is a column of its own, so that none is computed twice."""
    rows = rows.withColumn("plain", F.when(wanted, F.regexp_replace("text", MARKUP, "\n"))).withColumn("bare", F.col("plain"))
    for k, q in enumerate(QUOTES):
        rows = rows.withColumn(f"bare{k}", F.regexp_replace("bare", q, " ")).drop("bare").withColumnRenamed(f"bare{k}", "bare")
    whole = F.col("plain").rlike(r"(?s)\A\s*[{\[].*[}\]]\s*\z") | ~F.col("bare").rlike(r"[\p{L}\p{N}]")
    return rows.withColumn("all", F.when(whole, F.col("plain")).otherwise(F.col("bare"))).drop("plain", "bare").withColumnRenamed("all", "bare")


def skeleton(text: Column) -> Column:
    """Body with case, digits, markup and spacing masked."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"<[^>]{0,80}>|\p{N}+", " "), r"[^\p{L}]+", " "))


def evidence(documents: DataFrame, low_words: int = LOW_WORDS) -> DataFrame:
    """(doc_id, template, filler, error, scripts, notice, notion, mismatch, words, copies, titles, sources, at_odds) of every
    document with a text.

    ``notice`` and ``notion`` are only set for bodies of at most ``low_words`` words, which are low in information. ``copies``, ``titles``
    and ``sources`` count the documents of the same skeleton and ``at_odds`` is the share of them that mismatch (1 copy
    and no share for other bodies). ``words`` counts up to ``low_words`` + 2. Null and blank texts are left out; a null title or source has no terms and never
    matches.
    """
    d = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("title").cast("string"), F.lit("")).alias("title"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    ).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    kinds = {"template": PLACEHOLDERS, "filler": FILLER, "error": ERRORS, "scripts": SCRIPTS}
    low = F.col("low")
    d = d.withColumn("low", F.lower("text")).withColumns({f"{k}_seen": guarded(low, F.col("text"), ps) for k, ps in kinds.items()} | {"words": F.size(F.split(F.trim("text"), r"\s+", low_words + 2))})
    few = F.col("words") <= low_words
    d = d.withColumns({"low_text": F.when(few, low), "bone": F.when(few, skeleton(F.col("text")))})
    d = d.withColumn("template_seen", F.col("template_seen") | (F.contains("text", F.lit("<")) & F.col("text").rlike(r"<\p{Lu}[\p{Lu}\d]*_")))
    d = d.withColumn("filler_seen", F.col("filler_seen") | (F.regexp_count(low, F.lit(FILLER_HINT)) >= 3))
    seen = F.col("template_seen") | F.col("filler_seen") | F.col("error_seen") | F.col("scripts_seen")
    d = with_bare(d, seen | few)
    terms = F.filter(F.split(F.lower(F.concat_ws(" ", "title", F.element_at(F.split("source", "/"), -1))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    object_ = F.contains("text", F.lit('"')) & F.col("text").rlike(ERROR_OBJECT)
    also = {"error": object_, "filler": F.col("filler_seen") & F.lower("bare").rlike(FILLER_RUN)}
    flags = d.select(
        "doc_id", "words",
        *[((F.col(f"{k}_seen") & F.col("bare").rlike(any_of(ps))) | also.get(k, F.lit(False))).alias(k) for k, ps in kinds.items()],
        F.when(few, F.col("bare").rlike(any_of(NOTICES))).otherwise(F.lit(False)).alias("notice"),
        F.when(few, F.col("bare").rlike(NOTION)).otherwise(F.lit(False)).alias("notion"),
        F.when(few, ~F.exists(terms, lambda w: F.contains(F.col("low_text"), w))).otherwise(F.lit(False)).alias("mismatch"),
        # the others are spread by their ids. A skeleton of fewer than four words (a sign, a number, a table head) says too little to be a response
        F.coalesce(F.size(F.split("bone", " ")) >= 4, F.lit(False)).alias("short"),
        F.xxhash64(F.when(F.size(F.split("bone", " ")) >= 4, F.col("bone")).otherwise(F.col("doc_id").cast("string"))).alias("bone"),
        F.xxhash64("title").alias("t"),
        F.xxhash64("source").alias("s"),
    )
    shared = flags.where("short").groupBy("bone").agg(
        F.count("*").alias("copies"), F.approx_count_distinct("t").alias("titles"), F.approx_count_distinct("s").alias("sources"),
        F.avg(F.col("mismatch").cast("double")).alias("at_odds"),
    ).where("copies > 1")
    shared = shared.withColumnRenamed("bone", "of")
    out = flags.join(shared, F.col("short") & (F.col("bone") == F.col("of")), "left")
    return out.select(
        "doc_id", "template", "filler", "error", "scripts", "notice", "notion", "mismatch", "words",
        *[F.coalesce(c, F.lit(1)).alias(c) for c in ("copies", "titles", "sources")], F.coalesce("at_odds", F.lit(0.0)).alias("at_odds"),
    )


def residue(documents: DataFrame, many: int = 5, low_words: int = LOW_WORDS) -> DataFrame:
    """(doc_id): documents to leave out.

    A detector's find is enough; a body low in information counts as well if it uses no term of its title or slug and
    reads like a notice, or if it has one notion of a notice and is shared by at least ``many`` documents with ``many`` - 1
    titles of three sources, nearly all of them at odds with it.
    """
    e = evidence(documents, low_words)
    host = F.col("mismatch") & F.col("notion") & (F.col("copies") >= many) & (F.col("titles") >= many - 1) & (F.col("sources") >= 3) & (F.col("at_odds") >= 0.9)
    found = F.col("template") | F.col("filler") | F.col("error") | F.col("scripts") | (F.col("mismatch") & F.col("notice")) | host
    return e.where(found).select("doc_id").distinct()
