"""Text cleaning and text predicates as JVM-side column expressions.

Word boundaries are written out with Unicode classes, because the JVM's ``\\b`` is ASCII-only and would cut
words at accented letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns ------------------------------------------------------------------------------------
SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
LEFT = "(?<![\\p{L}\\p{N}_])"
RIGHT = "(?![\\p{L}\\p{N}_])"
PHONE = "\\(?(?<![\\p{L}\\p{N}_])\\d{3}\\)?[-.\\s]\\d{3}[-.\\s]\\d{4}(?![\\p{L}\\p{N}_])"
EMAIL = "(?<![\\p{L}\\p{N}_])[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+(?:\\.[\\p{L}\\p{N}_-]+)+(?![\\p{L}\\p{N}_])"
URL = "(?i)(?<![\\p{L}\\p{N}_])(?:https?://|www\\.)\\S*[^\\s.,;:!?)\\]]"
TITLE = "(?<![\\p{L}\\p{N}_])(?:Mr|Mrs|Ms|Miss|Mx)\\.?\\s+(?=[A-Z])"
LEADING_NAME = ("^(?:Dr\\.?\\s+|Prof\\.?\\s+|Professor\\s+)?((?:[A-Z][\\p{L}\\p{N}_'`-]*\\.?\\s+){0,3}[A-Z][\\p{L}\\p{N}_'`-]*)\\s+"
                "(?=(?:is|was|has|had|works|serves|received|earned|holds|graduated|joined|began|started|currently|"
                "specialises|specializes)(?![\\p{L}\\p{N}_]))")
NAME_TITLES = ["Dr", "Dr.", "Prof", "Prof.", "Professor", "Mr", "Mrs", "Ms", "Miss", "Mx"]
NOT_A_NAME = ["He", "She", "His", "Her", "Hers", "Him", "They", "Their", "It", "Its", "We", "Our", "I", "My", "This",
              "That", "These", "Those", "The", "A", "An", "In", "As", "At", "For", "With", "After", "Since",
              "Currently", "Today"]
PRONOUNS = [("herself", "themself"), ("himself", "themself"), ("hers", "theirs"), ("she", "they"), ("her", "their"),
            ("his", "their"), ("him", "them"), ("he", "they")]
AGREEMENT = [("has", "have"), ("is", "are"), ("was", "were"), ("does", "do"), ("hasn't", "haven't"),
             ("isn't", "aren't"), ("wasn't", "weren't"), ("doesn't", "don't")]
GENDERED_WORDS = ("she|he|her|hers|him|his|herself|himself|woman|man|female|male|daughter|son|wife|husband|mother|"
                  "father|mom|mum|dad|sister|brother|girl|boy|lady|gentleman|grandmother|grandfather|grandma|grandpa|"
                  "aunt|uncle|niece|nephew|girlfriend|boyfriend|stepmother|stepfather|fianc[eé]e?|actress|waitress|"
                  "hostess|businessman|businesswoman|chairman|chairwoman|spokesman|spokeswoman|congressman|congresswoman")
GENDERED_TITLES = "(?:Mr|Mrs|Ms|Miss|MR|MRS|MS)"
TOPICAL_WORDS = "women|men"
PLACE_BEFORE = ["in", "at", "of", "from", "near", "uc", "san", "santa", "santo", "st", "saint", "north", "south", "east",
                "west", "new", "fort", "lake", "mount", "puerto", "costa", "los", "las", "el", "port"]
PLACE_AFTER = ["university", "college", "institute", "school", "county", "street", "avenue", "hospital", "state", "tech",
               "city", "island", "river", "valley", "beach", "park", "center", "centre", "medical", "hall", "road",
               "drive", "square", "district", "province", "bay", "springs", "heights", "clinic", "foundation", "cancer",
               "health", "memorial", "children", "award", "prize", "fellowship", "scholarship", "lab", "laboratory",
               "library", "museum", "theatre", "theater", "airport", "law", "business"]
CLOSING_LINE = ("(?i)^[^\\p{L}\\p{N}_]*(?:sincerely|sincerly|regards|best regards|kind regards|respectfully|yours truly|"
                "yours sincerely|thank you|thanks|signed)(?![\\p{L}\\p{N}_])|,\\s*sincere?ly(?![\\p{L}\\p{N}_])")
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "st", "jr", "sr", "vs", "etc", "e.g", "i.e", "u.s", "a.m", "p.m", "no",
                 "fig", "prof"]
RUNS = {"words": "\\S", "sentences": "[.!?]", "syllables": "[aeiouyAEIOUY]"}            # what reading ease counts runs of
PLACEHOLDER = "(?<![\\p{L}\\p{N}_])(?:Generic_[A-Za-z]+|[A-Z]+_NAME)(?![\\p{L}\\p{N}_])"


def _c(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def collapse(text) -> Column:
    """Every whitespace run becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), SPACE + "+", " "))


def clean_paragraphs(text) -> Column:
    """Line ends unified; blank lines stay as paragraph breaks, other runs of whitespace become one space."""
    unified = F.regexp_replace(_c(text), "\r\n?", "\n")
    parts = F.split(unified, "\n[^\\S\n]*\n\\s*")
    tidy = F.transform(parts, lambda p: collapse(p))
    return F.array_join(F.filter(tidy, lambda p: p != ""), "\n\n")


def redact_contacts(text) -> Column:
    out = F.regexp_replace(_c(text), PHONE, "[phone]")
    out = F.regexp_replace(out, EMAIL, "[email]")
    return F.regexp_replace(out, URL, "[url]")


def strip_titles(text) -> Column:
    """Titles before a capitalised word; case-sensitive, so a degree or a verb is untouched."""
    return F.regexp_replace(_c(text), TITLE, "")


def neutral_pronouns(text) -> Column:
    """Gendered pronouns to singular they, keeping an initial capital."""
    out = _c(text)
    for word, repl in PRONOUNS:
        # the letter first, then the look-behind: most positions fail on one comparison
        upper, lower = (f"{c}(?<![\\p{{L}}\\p{{N}}_]{c})(?i:{word[1:]}){RIGHT}" for c in (word[0].upper(), word[0]))
        out = F.regexp_replace(F.regexp_replace(out, upper, repl.capitalize()), lower, repl)
    return out


def repair_agreement(text) -> Column:
    """``they has`` and the like; then a capital on a sentence-opening ``the applicant``."""
    out = _c(text)
    for have, want in AGREEMENT:
        out = F.regexp_replace(out, f"([tT](?<![\\p{{L}}\\p{{N}}_][tT])hey) {have}{RIGHT}", f"$1 {want}")
    return F.regexp_replace(out, f"(^|[.!?]\\s+)the applicant{RIGHT}", "$1The applicant")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def scrub(df: DataFrame, text: str, body: str = "body", flag: str = "name_resolved") -> DataFrame:
    """Adds the text without the sex signal it carries, and whether its opening named the subject.

    Contacts are redacted and titles stripped; a name that opens the text is replaced there and, together with
    the first name, everywhere later; pronouns become singular they; agreement is repaired. Each step is a column,
    so nothing is computed twice."""
    d = df.withColumn("__t", strip_titles(redact_contacts(collapse(text))))
    d = d.withColumn("__open", F.regexp_extract("__t", LEADING_NAME, 0))
    tokens = F.transform(F.split(F.regexp_extract("__t", LEADING_NAME, 1), "\\s+"),
                         lambda w: F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", ""))
    d = d.withColumn("__tok", F.filter(tokens, lambda w: (w != "") & ~w.isin(NAME_TITLES) & F.rlike(w, F.lit("^\\p{Lu}"))))
    head = F.try_element_at("__tok", F.lit(1))
    d = d.withColumn(flag, F.coalesce(head.isNotNull() & ~head.isin(NOT_A_NAME), F.lit(False)))
    rest = F.concat(F.lit("The applicant "), F.expr("substring(__t, length(__open) + 1)"))
    d = d.withColumn("__b", F.when(F.col(flag), rest).otherwise(F.col("__t")))
    full = F.array_join(F.transform("__tok", _quoted), "\\s+")
    first = F.try_element_at(F.filter("__tok", lambda w: F.length(w) > 1), F.lit(1))
    for pattern, applies in ((full, F.size("__tok") > 1), (_quoted(first), first.isNotNull())):
        d = d.withColumn("__b", F.when(F.col(flag) & applies, F.regexp_replace(
            F.col("__b"), F.concat(F.lit(LEFT), pattern, F.lit(RIGHT + "('s)?")), F.lit("the applicant$1"))).otherwise(F.col("__b")))
    merged = F.regexp_replace("__b", f"(?i){LEFT}(the applicant)(?:\\s+the applicant{RIGHT})+", "$1")
    d = d.withColumn("__b", F.when(F.col(flag), merged).otherwise(F.col("__b")))
    return d.withColumn(body, collapse(repair_agreement(neutral_pronouns("__b")))).drop("__t", "__open", "__tok", "__b")


def mentions(text, words: str, ignore_case: bool = True, starts: str = "") -> Column:
    """Whether one of the alternatives occurs as a whole word. ``starts``: the characters that they begin with; most places of a
    text then fail on one comparison, before the look-behind."""
    return F.rlike(_c(text), F.lit(("(?i)" if ignore_case else "") + (f"(?=[{starts}])" if starts else "") + f"{LEFT}(?:{words}){RIGHT}"))


def gendered(text) -> Column:
    return mentions(text, GENDERED_WORDS) | F.rlike(_c(text), F.lit(f"{LEFT}{GENDERED_TITLES}{RIGHT}\\.?(?=\\s+[A-Z])"))


def ends_with_signoff(text) -> Column:
    """The last non-empty line opens with a closing formula, or is a fragment of at most four words without
    terminal punctuation (closing quotes ignored)."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE[1:]}")))
    last = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), f"^{SPACE}+|{SPACE}+$", "")
    bare = F.regexp_replace(last, "[\"')”’\\x94]+$", "")
    fragment = (F.regexp_count(last, F.lit("\\S+")) <= 4) & ~F.rlike(bare, F.lit("[.!?]$"))
    return F.coalesce(F.rlike(last, F.lit(CLOSING_LINE)) | fragment, F.lit(False))


def words(text) -> Column:
    """Lower-case word tokens; digits count, hyphens split."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def word_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit("\\S+"))


def flesch(text) -> Column:
    """Reading ease with vowel groups as syllables; used for differences between near-identical texts."""
    t = _c(text)
    return reading_ease(*[F.regexp_count(t, F.lit(c + "+")) for c in RUNS.values()])


def reading_ease(words, sentences, syllables) -> Column:
    """`flesch` from the three counts."""
    n_words, sentences = (F.greatest(n, F.lit(1)).cast("double") for n in (words, sentences))
    return F.lit(206.835) - F.lit(1.015) * (n_words / sentences) - F.lit(84.6) * (syllables.cast("double") / n_words)


def shingles(text, n: int = 3) -> Column:
    """Distinct character n-grams."""
    t = F.lower(_c(text))
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array())


def occurrences(text, part) -> Column:
    """How often a literal string occurs, left to right without overlap."""
    t, p = _c(text), _c(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")
                  ).otherwise(F.lit(0))


def with_article(role) -> Column:
    """``software_engineer`` to ``a software engineer``; ``dj`` reads ``DJ``."""
    r = _c(role)
    name = F.when(r == "dj", F.lit("DJ")).otherwise(F.replace(r, F.lit("_"), F.lit(" ")))
    return F.concat(F.when(F.lower(F.substring(name, 1, 1)).isin(list("aeiou")), F.lit("an ")).otherwise(F.lit("a ")), name)


def sentence_boundaries(text) -> Column:
    """Character offsets just after a sentence end that is followed by a space or a line break; a full stop after
    an abbreviation, an initial or a dotted acronym does not end a sentence.

    One regular expression cuts the text after every candidate mark; offsets are running lengths of the pieces."""
    t = _c(text)
    pieces = F.regexp_extract_all(t, F.lit("(?s).*?[.?!][\"']?(?=[ \n])|.+$"), F.lit(0))

    def keeps(p: Column, nxt: Column) -> Column:
        def short(word: Column) -> Column:
            initial = F.rlike(word, F.lit("^[A-Z]$")) & (word != "I")
            acronym = F.rlike(word, F.lit("^[^.](?:\\.[^.])+$")) & nxt.startswith(" ")
            return F.lower(word).isin(ABBREVIATIONS) | initial | acronym

        # what several places need is bound by a lambda, which reads it once
        return ~(p.endswith(".") & F.exists(F.array(F.regexp_extract(p, "(?<![A-Za-z])([A-Za-z][A-Za-z.]*)\\.$", 1)), short))

    def bounds(pieces: Column) -> Column:
        following = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
        marked = F.zip_with(pieces, following, lambda p, nxt: F.struct(
            F.length(p).alias("n"), F.coalesce(keeps(p, nxt) & nxt.isNotNull(), F.lit(False)).alias("ok")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(marked, start, lambda acc, m: F.struct(
            (acc["at"] + m["n"]).alias("at"),
            F.when(m["ok"], F.array_append(acc["out"], acc["at"] + m["n"])).otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"])

    return F.get(F.transform(F.array(pieces), bounds), F.lit(0))


def insert_at(text, sentence, cut) -> Column:
    """The sentence after character ``cut``."""
    t = _c(text)
    return F.concat(F.substring(t, F.lit(1), cut), _c(sentence), F.substring(t, cut + 1, F.length(t)))


def conversation(prompt, response) -> Column:
    """Prompt and response as one role-delimited text."""
    return F.concat(F.lit("user: "), _c(prompt), F.lit("\n\nassistant: "), _c(response))
