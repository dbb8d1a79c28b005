"""Line-first quality rules, with built-in functions only.

Every line is judged by itself: punctuation (symbols in place of prose, or a short
scrap that no sentence mark ends), navigation (menu bars and links) and boilerplate
(notices).  Failing lines are removed; a document that loses more than half of its
words is rejected, as is one that fails the base rules.  There is no shuffle, and
windows of words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import SYMBOL, WORD

#: Notices and menu entries in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "lorem ipsum",
    "javascript is disabled", "enable javascript", "accept cookies", "uses cookies", "click here", "subscribe to our newsletter", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d.utilisation", "utilise des cookies", "cliquez ici", "abonnez-vous",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies", "haga clic aquí", "suscríbase",
)
MENU = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top", "contact", "contact us", "about", "about us", "share", "read more", "skip to content", "search", "sitemap",
    "startseite", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "kontakt", "über uns", "teilen", "weiterlesen", "suche", "impressum",
    "accueil", "connexion", "se connecter", "inscription", "suivant", "précédent", "haut de page", "contactez-nous", "à propos", "partager", "lire la suite", "recherche", "plan du site",
    "inicio", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "contacto", "sobre nosotros", "compartir", "leer más", "buscar", "mapa del sitio",
)

WINDOW = 8


def _lines(text) -> F.Column:
    """For each line: words, symbols, and whether it fails a rule.  Lines of texts that
    have no sign of the kind anywhere are not searched for each."""
    return _let(text.rlike(SYMBOL + r"|[»•›]|[!?]{2}"), lambda signs: _measured(text, signs))


def _measured(text, signs) -> F.Column:
    count = lambda l, pattern: F.when(signs, F.regexp_count(l, F.lit(pattern))).otherwise(0)
    measured = F.transform(
        F.split(text, "\n"),
        lambda l: F.struct(
            l.alias("line"),
            F.regexp_count(l, F.lit(WORD)).alias("words"),
            count(l, SYMBOL).alias("symbols"),
            count(l, r"[|»•›]").alias("bars"),
            count(l, r"[!?]{2,}").alias("shouts"),
        ),
    )

    def fails(x):
        words, line = x["words"], x["line"]
        symbols = F.greatest(x["symbols"] - x["bars"], x["shouts"]) * 10 > words * 3
        scrap = (words < 3) & ~line.rlike(r"[.!?:;,…。！？\"'”»)\]][\x09-\x0D\x20]*$")
        bar = (x["bars"] >= 2) & (x["bars"] * 4 >= words)
        menu = (words <= 4) & line.rlike(r"(?iu)^[^\p{L}]*(" + "|".join(MENU) + r")[^\p{L}]*$")
        notice = (words <= 40) & line.rlike("(?iu)" + "|".join(BOILERPLATE))
        return (words > 0) & (symbols | scrap | bar | menu | notice)

    return F.transform(measured, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), x["symbols"].alias("symbols"), fails(x).alias("fails")))


def _let(value: F.Column, body) -> F.Column:
    """body(value), with the value computed once for each row: a lambda's variable is
    not copied into other expressions by the optimizer, as a projection's may be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(x: F.Column, f) -> F.Column:
    """f of each element and the next."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), f)


def _repeated(w: F.Column) -> F.Column:
    """The number of words in WINDOW-word windows that occur twice or more."""
    double = lambda h, k: F.zip_with(h, F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def covered(starts):  # sorted
        return F.aggregate(_pairs(starts, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW).cast("long"), lambda s, x: s + x)

    def count(h):
        placed = lambda: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = lambda s: F.sort_array(F.array_distinct(F.flatten(F.array_compact(_pairs(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(placed(), lambda s: _let(starts(s), covered))).otherwise(F.lit(0).cast("long"))

    ones = F.transform(w, lambda x: F.xxhash64(x))
    return _let(ones, lambda h1: _let(double(h1, 1), lambda h2: _let(double(h2, 2), lambda h4: _let(F.slice(double(h4, 4), F.lit(1), F.greatest(F.size(h4) - (WINDOW - 1), F.lit(0))), count))))


def measure(docs: DataFrame, *, most_lost: int = 50, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """`docs` with a struct column `__rules`: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, words_lost, base_failed, kept, clean_text (the lines
    that pass).  Limits are percentages of words.

    A very long text is judged whole, in arrays of some 100 bytes a word.
    A null or empty text has no words and fails; repeated rows are judged alike; an
    empty table stays empty; columns of any other names pass through untouched.
    """
    text = F.coalesce("text", F.lit(""))
    total = lambda x, f: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + f(v))

    def from_words(w):
        return F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("repeated"))

    def from_lines(l):
        full = F.filter(l, lambda x: x["words"] > 0)
        return _let(full, lambda p: F.struct(
            total(l, lambda x: x["symbols"]).alias("symbols"),
            (F.size(p) - F.size(F.array_distinct(F.transform(p, lambda x: x["line"])))).cast("long").alias("dup"),
            total(p, lambda x: F.when(x["fails"], x["words"]).otherwise(0)).alias("lost"),
            F.array_join(F.transform(F.filter(l, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean"),
        ))

    def judged(w, l):
        failed = (w["n"] < least_words) | (w["repeated"] * 100 > w["n"] * most_repeated)
        return F.struct(
            w["n"].alias("n_words"), w["chars"].alias("word_chars"), l["symbols"].alias("n_symbols"), l["dup"].alias("n_dup_lines"), w["repeated"].alias("n_repeat_words"),
            l["lost"].alias("words_lost"), failed.alias("base_failed"), (~failed & (l["lost"] * 100 <= w["n"] * most_lost)).alias("kept"), l["clean"].alias("clean_text"),
        )

    words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), from_words)
    return docs.withColumn("__rules", _let(words, lambda w: _let(_let(_lines(text), from_lines), lambda l: judged(w, l))))


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept: one row for each row of `docs`."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measure(docs.select("doc_id", "text"), **limits).select("doc_id", *[F.col(f"__rules.{c}").alias(c) for c in names])


def kept_rows(docs: DataFrame, **limits) -> DataFrame:
    """The rows of `docs` that are kept, without the lines that fail.  Where lines went,
    `n_chars` (if there is one) is the new length; other columns pass through."""
    names = [f"`{c}`" for c in docs.columns if c != "__rules"]
    passed = F.explode(F.filter(F.array("__rules"), lambda r: r["kept"]))  # where() would be pushed down with a copy of the rules
    kept = measure(docs, **limits).select(*names, passed.alias("__rules"))
    clean = F.col("__rules.clean_text")
    changed = {"text": clean}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(clean == F.col("text"), F.col("n_chars")).otherwise(F.char_length(clean)).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(changed).drop("__rules")
