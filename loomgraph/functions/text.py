"""Scalar text functions as Column expressions; everything here stays inside whole-stage code.

Null texts count as empty where a function returns text or a list, unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and phrases whose content decides results.
DETERMINERS = ["the", "a", "an", "this", "that", "these", "those", "his", "her", "their", "my", "your", "our"]
PRONOUNS = ["i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "we", "us", "our", "ours", "they", "them", "their", "theirs", "this", "that", "these", "those", "who", "whom", "whose"]
ANCHOR_PRONOUNS = ["he", "him", "his", "himself", "she", "her", "hers", "herself", "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "one"]
GENERIC_HEADS = ["person", "people", "man", "men", "woman", "women", "child", "children", "thing", "one", "other", "someone", "somebody", "anyone", "anybody", "nobody"]
GENERIC_PHRASES = ["someone", "somebody", "anyone", "anybody", "nobody", "no one", "the others", "the other", "another", "others", "a man", "the man", "a woman", "the woman", "a person", "the person"]
GENERIC_ANCHORS = ["someone", "somebody", "anyone", "anybody", "everyone", "everybody", "no one", "nobody", "person", "people", "persons", "man", "men", "woman", "women", "boy", "boys", "girl", "girls", "friend", "friends", "companion", "companions", "traveler", "travelers", "stranger", "strangers", "thing", "things", "creature", "creatures", "animal", "animals", "road", "forest", "house", "room", "place", "country", "city", "town", "voice", "voices", "head", "hand", "hands", "eyes"]
FIRST_SECOND_PERSON = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves"]
SUBJECT_PRONOUNS = ["he", "she", "they", "it"]
OBJECT_PRONOUNS = ["him", "her", "them"]
POSSESSIVE_PRONOUNS = ["his", "hers", "their", "theirs", "its"]
REFLEXIVE_PRONOUNS = ["himself", "herself", "itself", "themself", "themselves"]
KEPT_NOMINALS = ["my dear", "your dear", "my friend", "your friend", "our friend", "this fellow", "that fellow", "the poor fellow", "the stranger", "the creature"]
NO_POSSESSUM = [",", ".", ";", ":", "!", "?", "and", "or", "but", "to", "of", "in", "on", "at", "by", "with", "from", "for", "as"]

#: Blanks as Unicode has them, in a class both Java and RE2 read.
BLANK = "[\\s" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{BLANK}+|{BLANK}+$", "")


def squeeze(x: Column | str) -> Column:
    """Trimmed, with each run of blanks as one."""
    return strip(F.regexp_replace(col(x), f"{BLANK}+", " "))


def clean_text(x: Column | str) -> Column:
    """A raw text as paragraphs of one line each.

    In this order: line ends, byte-order marks and curly quotes become plain, lines of digits go,
    lines of a paragraph are joined, chapter headings go, blanks are squeezed. Null stays null.
    """
    t = F.regexp_replace(col(x), "\r\n?", "\n")
    t = F.translate(t, "\ufeff", "")
    t = F.translate(t, "’‘“”", "''\"\"")
    t = F.regexp_replace(t, r"(?md)^[ \t]*[0-9]+[ \t]*$", "")
    kept = F.filter(F.split(t, "\n\n"), lambda p: F.length(strip(p)) > 0)
    t = F.array_join(F.transform(kept, lambda p: strip(F.regexp_replace(p, f"{BLANK}*\n{BLANK}*", " "))), "\n\n")
    t = F.regexp_replace(t, r"(?imd)^\s*chapter\s+(?:[ivxlcdm]+|[0-9]+)\b[^\n]*\n*", "")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def normalize(x: Column | str) -> Column:
    return F.lower(squeeze(F.coalesce(col(x).cast("string"), F.lit(""))))


def none_if_nan(x: Column | str) -> Column:
    """Null for null and for any spelling of nan."""
    value = col(x).cast("string")
    return F.when(F.lower(value) != "nan", value)


def canonical_key(x: Column | str) -> Column:
    """Lower case without possessive endings, leading articles and punctuation."""
    t = F.lower(strip(F.coalesce(col(x).cast("string"), F.lit(""))))
    t = F.translate(t, "’‘`", "'''")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([a-z0-9]+)'s(?![\p{L}\p{N}_])", "$1")
    t = F.regexp_replace(t, f"^((the|a|an){BLANK}+)+", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def tokens_of(key: Column | str) -> Column:
    return F.filter(F.split(col(key), " "), lambda w: w != "")


def content_tokens(x: Column | str) -> Column:
    """Words of letters and digits that are no determiners, in order."""
    return F.filter(F.regexp_extract_all(normalize(x), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(DETERMINERS))


def entity_phrase(x: Column | str) -> Column:
    return F.array_join(content_tokens(x), " ")


def singular(w: Column) -> Column:
    return (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substring(w, 1, F.length(w) - 3), F.lit("y")))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.substring(w, 1, F.length(w) - 1))
        .otherwise(w)
    )


def token_set(x: Column | str) -> Column:
    return F.array_distinct(F.transform(content_tokens(x), singular))


def head_word(x: Column | str) -> Column:
    """The last content word in the singular, empty where there is none."""
    words = content_tokens(x)
    return F.when(F.size(words) > 0, singular(F.element_at(words, -1))).otherwise("")


def is_generic_head(head: Column) -> Column:
    word = singular(head)
    return (word == "") | word.isin(GENERIC_HEADS)


def is_generic_nominal(x: Column | str) -> Column:
    text = normalize(x)
    return (text == "") | text.isin(GENERIC_PHRASES) | is_generic_head(head_word(x))


def is_pronoun(x: Column | str) -> Column:
    return normalize(x).isin(PRONOUNS)


def is_proper_name(x: Column | str) -> Column:
    """Some alphabetic word starts with a capital and the whole is no pronoun; false for null."""
    return F.coalesce(col(x).rlike("(^|[^A-Za-z])[A-Z]") & ~is_pronoun(x), F.lit(False))


def is_relevant_mention(x: Column | str) -> Column:
    return ~is_pronoun(x) & (F.size(content_tokens(x)) > 0)


def is_anchor_candidate(key: Column | str, extra_generic: list[str] | None = None) -> Column:
    """A key that may serve as an anchor: no pronoun, not generic, not digits only, not one or two letters."""
    k = col(key)
    return (k != "") & ~k.isin(ANCHOR_PRONOUNS) & ~k.isin(GENERIC_ANCHORS + (extra_generic or [])) & ~k.rlike("^[0-9 ]+$") & ~((F.size(tokens_of(k)) == 1) & (F.length(k) <= 2))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def surface_similarity(left: Column | str, right: Column | str, threshold: float) -> Column:
    """struct(is_match, score, head) of two phrases: equal, or same specific head with containment or enough overlap."""
    lp, rp, lh, rh, lt, rt = entity_phrase(left), entity_phrase(right), head_word(left), head_word(right), token_set(left), token_set(right)
    score = jaccard(lt, rt)
    same = (lh == rh) & (lh != "") & ~is_generic_head(lh)
    contained = (F.size(F.array_except(lt, rt)) == 0) | (F.size(F.array_except(rt, lt)) == 0)

    def result(match: Column, value: Column, head: Column) -> Column:
        return F.struct(match.alias("is_match"), value.cast("double").alias("score"), head.alias("head"))

    return (
        F.when((lp == "") | (rp == ""), result(F.lit(False), F.lit(0.0), F.lit("")))
        .when(lp == rp, result(F.lit(True), F.lit(1.0), lh))
        .when(~same, result(F.lit(False), F.lit(0.0), F.when(lh == rh, lh).otherwise("")))
        .otherwise(result(contained | (score >= threshold), score, lh))
    )


def context_key(x: Column | str) -> Column:
    """A context without the blanks that tokenization put before punctuation, clitics and around dashes."""
    t = squeeze(x)
    t = F.regexp_replace(t, r" ([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"(?i) ('s|'re|'ve|'ll|'d|'m|n't)\b", "$1")
    return F.trim(F.regexp_replace(t, f"{BLANK}*—{BLANK}*", "—"))


def possessive(subject: Column | str) -> Column:
    name = F.coalesce(F.nullif(strip(col(subject)), F.lit("")), F.lit("the character"))
    return F.when(name.endswith("'"), name).when(name.endswith("s"), F.concat(name, F.lit("'"))).otherwise(F.concat(name, F.lit("'s")))


def rendered_mention(mention: Column | str, subject: Column | str, next_token: Column | None = None, next_pos: Column | None = None, is_possessive: Column | None = None, canonicalize: bool = True, keep_persons: bool = True) -> Column:
    """struct(replacement, rule): what stands for a mention when its context is rendered.

    ``next_token`` and ``next_pos`` describe the token after the mention and ``is_possessive`` whether
    the mention's own tag is possessive; they decide only what ``her`` means.
    """
    clean = context_key(mention)
    low = F.lower(clean)
    name = F.coalesce(F.nullif(strip(col(subject)), F.lit("")), F.lit("the character"))
    owned = F.coalesce(is_possessive if is_possessive is not None else F.lit(None).cast("boolean"), F.lit(False))
    if next_token is not None:
        following = F.lower(next_token)
        noun = next_pos.isin("NOUN", "PROPN", "ADJ") if next_pos is not None else F.lit(False)
        owned = owned | F.coalesce(~following.isin(NO_POSSESSUM) & (F.coalesce(noun, F.lit(False)) | following.rlike("^[a-zA-Z][a-zA-Z'-]*$")), F.lit(False))
    proper = (low == F.lower(context_key(name))) | F.exists(F.split(clean, f"{BLANK}+"), lambda w: w.rlike("^\\p{Lu}") & (F.lower(w) != "i"))
    nominal = ~low.isin(KEPT_NOMINALS) & low.startswith("the ") & (F.size(F.split(low, " ")) <= 4)

    def out(text: Column, rule: str) -> Column:
        return F.struct(text.alias("replacement"), F.lit(rule).alias("rule"))

    if not canonicalize:
        return out(clean, "canonicalization_disabled_keep_original")
    possessed = out(possessive(name), "third_person_possessive_pronoun_to_canonical_possessive")
    thing = out(name, "third_person_object_pronoun_to_canonical")
    return (
        F.when(F.lit(keep_persons) & low.isin(FIRST_SECOND_PERSON), out(clean, "first_second_person_keep_original"))
        .when(proper, out(name, "proper_name_to_canonical"))
        .when(low.isin(SUBJECT_PRONOUNS), out(name, "third_person_subject_pronoun_to_canonical"))
        .when((low == "her") & owned, possessed)
        .when(low.isin(OBJECT_PRONOUNS), thing)
        .when(low.isin(POSSESSIVE_PRONOUNS), possessed)
        .when(low.isin(REFLEXIVE_PRONOUNS), out(clean, "third_person_reflexive_keep_original"))
        .when(nominal, out(name, "simple_nominal_to_canonical"))
        .otherwise(out(clean, "ambiguous_or_unsupported_keep_original"))
    )


def local_name(iri: Column | str) -> Column:
    """What follows the last ``#``, else the last ``/``."""
    x = col(iri)
    return F.when(F.instr(x, "#") > 0, F.substring_index(x, "#", -1)).otherwise(F.substring_index(F.rtrim(x, F.lit("/")), "/", -1))


def iri_namespace(iri: Column | str) -> Column:
    return F.regexp_extract(col(iri), "^(.*[#/])[^#/]*$", 1)


def short_iri(iri: Column | str) -> Column:
    return F.coalesce(F.nullif(local_name(strip(iri)), F.lit("")), F.lit("UNKNOWN"))


def human_label(x: Column | str) -> Column:
    """Camel, snake and kebab case as words with capitals; words in capitals stay."""
    t = F.regexp_replace(F.translate(local_name(x), "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(strip(t), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w) == w, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000)))), " ")


def label_key(x: Column | str) -> Column:
    return F.lower(squeeze(F.coalesce(col(x), F.lit(""))))


def identifier_key(x: Column | str) -> Column:
    """An IRI or label folded to lower-case words."""
    return F.lower(squeeze(F.regexp_replace(F.translate(local_name(x), "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2")))


#: Letters with marks and their plain letters, for the Latin alphabets of the corpus.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def iri_local(name: Column | str) -> Column:
    """A name as the local part of an IRI: plain letters, digits and underscores."""
    t = F.regexp_replace(F.translate(strip(name), MARKED, PLAIN), "[^\\x00-\\x7f]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\s+", "_"), "[^A-Za-z0-9_]", "")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("entity_"), t)).otherwise(t)


def relation_id(source: Column | str, predicate: Column | str, target: Column | str) -> Column:
    return F.concat_ws("_", F.lit("rel"), col(source), col(predicate), col(target))


def assertion_id(source: Column | str, iri: Column | str, target: Column | str) -> Column:
    return F.concat_ws("_", F.lit("assertion"), col(source), local_name(iri), col(target))


def local_cluster_uid(chunk_id: Column | str, cluster: Column | str) -> Column:
    return F.concat(col(chunk_id), F.format_string("::cluster_%03d", col(cluster).cast("bigint")))


def local_mention_uid(cluster_uid: Column | str, mention: Column | str) -> Column:
    return F.concat(col(cluster_uid), F.format_string("::mention_%03d", col(mention).cast("bigint")))


def global_cluster_uid(number: Column | str) -> Column:
    return F.format_string("global_cluster_%06d", col(number).cast("bigint"))


def cluster_number(uid: Column | str) -> Column:
    """The number in a global cluster uid; null for anything else (callers assert)."""
    return F.expr("try_cast(nullif(regexp_extract(%s, '^global_cluster_([0-9]+)$', 1), '') as bigint)" % uid) if isinstance(uid, str) else F.nullif(F.regexp_extract(uid, "^global_cluster_([0-9]+)$", 1), F.lit("")).cast("bigint")


def overlap_span_key(zone: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    return F.when(col(zone) == "core", "").otherwise(F.concat_ws(":", col(start).cast("string"), col(end).cast("string"), normalize(text)))


def safe_name(x: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(strip(x), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def truncate(x: Column | str, size: int) -> Column:
    t = squeeze(x)
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def literal_text(x: Column | str) -> Column:
    """A number with at most two decimals and no trailing zeros."""
    number = col(x).cast("double")
    return F.when(number.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.2f", number), "(\\.[0-9]*?)0+$", "$1"), "\\.$", ""))


def short_id(x: Column | str, size: int = 16) -> Column:
    return F.substring(F.sha1(col(x)), 1, size)


def clean_canonical(x: Column | str) -> Column:
    """A text fit as a cluster's name: one line, no quotes or sentence marks, at most eight words."""
    t = col(x)
    return (F.length(strip(t)) > 0) & ~t.rlike("[\n\"“”.!?;:]") & (F.size(F.split(squeeze(t), " ")) <= 8)


def loosely_equal(a: Column | str, b: Column | str) -> Column:
    return F.regexp_replace(normalize(a), "[^\\p{L}\\p{N}]", "") == F.regexp_replace(normalize(b), "[^\\p{L}\\p{N}]", "")
