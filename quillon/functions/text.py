"""Text functions. All are built-in expressions, so they stay in generated code; patterns keep to what Java and RE2 share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the answer scorers and the query parsers.
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
STOPWORDS = (
    "the", "and", "for", "are", "was", "were", "with", "that", "this", "from", "have", "has", "had", "not", "but", "which",
    "what", "when", "where", "who", "how", "why", "can", "could", "does", "did", "been", "being", "into", "than", "then", "there", "these", "those",
)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def collapse(column: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_text(column), r"[ \t\n\r\f\x0B]+", " "))


def words(column: Column) -> Column:
    """The words between spaces; none of an empty text."""
    return F.filter(F.split(collapse(column), " "), lambda w: w != "")


def answer_tokens(column: Column) -> Column:
    """Lower case, punctuation as space, without articles."""
    cleaned = F.regexp_replace(F.lower(_text(column)), PUNCTUATION, " ")
    return F.filter(words(cleaned), lambda w: ~w.isin(*ARTICLES))


def alnum(column: Column) -> Column:
    """Lower case with everything but a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_text(column)), "[^a-z0-9]+", " "))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once, however often `use` has it: inside a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kgrams(column: Column, k: int, least: int = 12) -> Column:
    """The runs of k words of the alnum form; of a text under `least` words, the whole of it as one; of an empty one, none."""
    joined = lambda part: F.array_join(part, " ")

    def of(found: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found) - (k - 1))), lambda i: joined(F.slice(found, i, k)))
        return F.when(F.size(found) == 0, F.array().cast("array<string>")).when(F.size(found) < least, F.array(joined(found))).otherwise(runs)

    return once(F.filter(F.split(alnum(column), " "), lambda w: w != ""), of)


def query_terms(column: Column, most: int | None = 10) -> Column:
    """Distinct lower-case words of three letters and more that are no stopwords, in order, the first `most`."""
    found = F.regexp_extract_all(F.lower(_text(column)), F.lit("([a-z0-9_]+)"), 1)
    kept = F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))
    return F.slice(kept, 1, most) if most else kept


def sentences(column: Column) -> Column:
    """Split behind . ! ? and white space; blank parts are dropped."""
    marked = F.regexp_replace(_text(column), r"([.!?])[ \t\n\r]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def first_sentence(column: Column) -> Column:
    """Up to the first . ! or ? before white space or the end; else the whole."""
    return F.element_at(F.concat(sentences(column), F.array(F.lit(""))), 1)


def compress(column: Column, most_sentences: int = 2, most_chars: int = 420) -> Column:
    """The first sentences within a length, without trailing spaces, commas, semicolons and colons."""
    joined = F.array_join(F.slice(sentences(collapse(column)), 1, most_sentences), " ")
    return F.regexp_replace(F.substring(joined, 1, most_chars), "[ ,;:]+$", "")


def capitalised_phrases(column: Column) -> Column:
    """Distinct runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(_text(column), F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"), 1))


def rs_ids(column: Column, most: int = 3) -> Column:
    """The first distinct dbSNP ids."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(_text(column)), F.lit(r"\b(rs[0-9]{3,})\b"), 1)), 1, most)


def gene_shaped(column: Column, most: int = 5) -> Column:
    """The first distinct tokens of capitals and digits that look like gene symbols."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_text(column), F.lit(r"\b([A-Z][A-Z0-9]{2,9})\b"), 1)), 1, most)


def without_choices(column: Column) -> Column:
    """Without a trailing block that begins with `Answer Choices:`."""
    return F.regexp_replace(_text(column), r"(?is)\s*answer choices:.*$", "")


def without_tokens(column: Column, tokens: tuple[str, ...] = ("<s>", "</s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")) -> Column:
    """Without control tokens of generators, trimmed."""
    for token in tokens:
        column = F.replace(column, F.lit(token), F.lit(""))
    return F.trim(column)


def chromosome(column: Column) -> Column:
    """`chromosome 7`, `chr7`, `7` (also q and p arms behind it) as chr7; anything else lower case, trimmed."""
    low = F.trim(F.lower(_text(column)))
    name = F.regexp_extract(low, r"^(?:chromosome |chr ?)?([0-9]{1,2}|x|y|mt)(?:[pq][0-9.]*)?$", 1)
    return F.when(name != "", F.concat(F.lit("chr"), F.upper(name))).otherwise(low)


def tree_parent(column: Column) -> Column:
    """A dotted tree number without its last part; empty at the top."""
    return F.regexp_replace(column, r"(^[^.]*$|\.[^.]*$)", "")


def url_domain(column: Column) -> Column:
    """The host in lower case, without `www.` and port."""
    return F.regexp_replace(F.regexp_extract(F.lower(_text(column)), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")


def in_domains(domain: Column, domains: tuple[str, ...]) -> Column:
    """Whether a domain is one of these or below one of them."""
    return F.coalesce(F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d))), F.lit(False))


def article_id(url: Column) -> Column:
    """The article number of a URL by three patterns, the first that matches; null if none does."""
    tries = [F.nullif(F.regexp_extract(_text(url), p, 1), F.lit("")) for p in (r"pubmed\.[a-z.]+/([0-9]+)", r"/pubmed/([0-9]+)", r"[?&](?:term|id)=([0-9]+)")]
    return F.coalesce(*tries)


def dataset_of(item_id: Column, prefixes: dict[str, str]) -> Column:
    """The dataset of an item by the first prefix that fits, else what stands before the first underscore."""
    out = None
    for prefix, name in prefixes.items():
        fits = F.startswith(item_id, F.lit(prefix))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    rest = F.element_at(F.split(item_id, "_"), 1)
    return rest if out is None else out.otherwise(rest)


def token_estimate(column: Column, kind: str = "ceil") -> Column:
    """Tokens of a text by length: `ceil` (one at least), `up` or `down` quarter of the characters."""
    n = F.length(_text(column))
    return {"ceil": F.greatest(F.lit(1), F.ceil(n / 4)), "up": F.floor((n + 3) / 4), "down": F.floor(n / 4)}[kind].cast("long")


def section_role(column: Column) -> Column:
    """The role of a section by its title: the first of these kinds that a pattern fits, else raw."""
    low = F.lower(_text(column))
    kinds = (("abstract", "abstract|summary"), ("intro", "intro|background"), ("methods", "method|material|procedure"), ("results", "result|finding"), ("discussion", "discuss"), ("conclusion", "conclu"))
    out = F.when(low.rlike(kinds[0][1]), kinds[0][0])
    for role, pattern in kinds[1:]:
        out = out.when(low.rlike(pattern), role)
    return out.otherwise("raw")


def blocked_section(role: Column, title: Column, roles: tuple[str, ...] = ("references", "acknowledgements", "funding"), patterns: tuple[str, ...] = ("reference", "acknowledg", "funding", "conflict of interest", "supplement", "author contribution")) -> Column:
    """Whether a section never gives evidence: by its role, or a pattern in role and title."""
    both = F.lower(F.concat_ws(" ", _text(role), _text(title)))
    return role.isin(*roles) | both.rlike("|".join(patterns))


def header_or(column: Column, default: str) -> Column:
    return F.when(F.trim(_text(column)) == "", default).otherwise(column)


def search_expression(keywords: Column, all_of: bool = False) -> Column:
    """A full-text search expression: words of a keyword next to each other, keywords joined by | or &; signs are dropped, empty keywords too."""
    cleaned = F.filter(F.transform(keywords, alnum), lambda k: k != "")
    terms = F.transform(cleaned, lambda k: F.when(F.contains(k, F.lit(" ")), F.concat(F.lit("("), F.replace(k, F.lit(" "), F.lit(" <-> ")), F.lit(")"))).otherwise(k))
    return F.array_join(terms, " & " if all_of else " | ")
