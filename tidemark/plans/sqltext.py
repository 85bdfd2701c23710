"""DuckDB fragments that the queries' SQL texts share; each mirrors an expression of functions.text."""

from __future__ import annotations

from tidemark.functions import fixed as V
from tidemark.functions import text as X


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def sentences(c: str) -> str:
    marked = f"regexp_replace(coalesce({c}, ''), '([.!?])\\s+([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def content_tokens(c: str, stop=V.CONTENT_STOP, longer_than: int = 2) -> str:
    return f"list_distinct(list_filter({tokens(c)}, lambda t: length(t) > {longer_than} and t not in ({quoted(stop)})))"


def normalized(c: str) -> str:
    return f"array_to_string({tokens(c)}, ' ')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def slugify(c: str, default: str = "untitled", most: int = 60) -> str:
    s = f"lower(coalesce({c}, ''))"
    for sign, letters in X.SEVERAL.items():
        s = f"replace({s}, '{sign}', '{letters}')"
    s = f"regexp_replace(regexp_replace(translate({s}, '{X.ACCENTS[0]}', '{X.ACCENTS[1]}'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g')"
    s = f"regexp_replace(substring(regexp_replace({s}, '^-+|-+$', '', 'g'), 1, {most}), '-+$', '')"
    return f"case when {s} = '' then '{default}' else {s} end"


def site_key(c: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce({c}, ''), {text(p)}, 1), '')" for p in X.SITE_KEYS) + ")"


def text(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


def epistemic_type(c: str) -> str:
    low = f"(' ' || lower({strip(c)}) || ' ')"
    whens = " ".join(f"when {' or '.join(f'contains({low}, {quoted([w])})' for w in words)} then '{label}'" for label, words in V.TYPE_CUES)
    return f"case {whens} else 'FACT' end"


def predicate_of(c: str) -> str:
    whens = " ".join(f"when instr(lower({c}), ' {cue} ') > 1 then '{cue}'" for cue in V.PREDICATES)
    return f"case {whens} else '' end"


def salience(c: str) -> str:
    t = tokens(c)
    capital = f"len(list_filter(list_slice(regexp_split_to_array(trim({c}), '\\s+'), 2, 1000000), lambda w: regexp_matches(w, '^[A-Z]')))"
    digit = f"len(list_filter({t}, lambda w: regexp_matches(w, '[0-9]'))) > 0"
    return f"case when len({t}) = 0 then 0.0::double else 0.5::double * least(1.0::double, len({t}) / 25.0::double) + case when {digit} then 0.25::double else 0.0::double end + 0.25::double * least(1.0::double, {capital} / 5.0::double) end"


def low_value(c: str) -> str:
    low, n = f"lower({strip(f"coalesce({c}, '')")})", f"len({tokens(c)})"
    greets = " or ".join(f"starts_with({low}, {text(g)})" for g in V.GREETINGS)
    calls = " or ".join(f"contains({low}, {text(x)})" for x in V.CALLS)
    return f"""(length({low}) < 2 or (({greets}) and {n} <= 8) or regexp_matches({low}, {text(V.AD_LEAD)}) or (({calls}) and regexp_matches({low}, {text(V.PAGE)}))
 or coalesce({tokens(c)}[1] in ({quoted(V.NAVIGATION)}), false) and {n} <= 6)"""


def fragment(c: str) -> str:
    return f"regexp_matches({strip(f"coalesce({c}, '')")}, '^\\p{{Ll}}')"


def punctuated(c: str) -> str:
    s = strip(f"coalesce({c}, '')")
    return f"""(regexp_matches({s}, '[.!?]["'')\\]]?\\s+[A-Z0-9"''(]') or regexp_matches({s}, '^\\p{{Lu}}[\\s\\S]*[.!?]$'))"""


def mentions(c: str) -> str:
    """RE2's word bounds know ASCII only, so accented letters are turned into a word character first."""
    a = f"regexp_replace(coalesce({c}, ''), '[À-ÖØ-öø-ÿŒœ]', '_', 'g')"
    runs = f"list_transform(regexp_extract_all({a}, '\\b[A-Z][a-z]+(\\s+[A-Z][a-z]+)*\\b'), lambda m: regexp_replace(regexp_replace(m, {text(X.opening_words(V.OPENING_CAPITALS))}, ''), '\\s+', ' ', 'g'))"
    return f"list_filter(list_concat(regexp_extract_all({a}, '\\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)?)s?\\b', 1), {runs}), lambda m: m <> '')"


def six(c: str) -> str:
    return f"floor(({c}) * 1e6::double + 0.5::double) / 1e6::double"


def _replaced(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, {text(pattern)}, {text(by)}, 'g')"
    return c


def bare(c: str) -> str:
    s = _replaced(f"coalesce({c}, '')", (X.TAG, " "))
    for code, sign in X.ENTITIES:
        s = f"replace({s}, {text(code)}, {text(sign)})"
    return s


def unlinked(c: str) -> str:
    return _replaced(bare(c), (X.SOUND, " "), (X.LINK, r"\1"), (X.PAGE_IN_PARENS, " "))


def events_in(c: str) -> str:
    notes = f"list_filter(regexp_extract_all({unlinked(c)}, {text(X.BRACKET)}), lambda x: regexp_matches(x, '[A-Za-z]{{3}}'))"
    inner = strip("regexp_replace(x, '^\\[|\\]$', '', 'g')")
    return f"list_concat(list_transform(regexp_extract_all({bare(c)}, {text(X.SOUND)}, 1), lambda x: lower(x)), list_transform({notes}, lambda x: substring(lower({inner}), 1, 40)))"


def clean_caption(c: str) -> str:
    """RE2 has no lookahead: a note is told by a word of three letters within its brackets."""
    s = _replaced(unlinked(c), (X.CENSORED, " "), (r"\[[^\]\n]{0,57}[A-Za-z]{3}[^\]\n]{0,57}\]", " "), (r">>+\s*", " "))
    name = f"regexp_extract({s}, {text(X.NAME_PREFIX)}, 1)"
    words = f"regexp_split_to_array({strip(name)}, '\\s+')"
    letters = "regexp_replace(w, '[^A-Za-z]', '', 'g')"
    fits = f"len(list_filter({words}, lambda w: regexp_matches({letters}, '^([A-Z]|$)') or lower({letters}) in ({quoted(V.NAME_PARTICLES)}))) = len({words})"
    named = f"{name} <> '' and len({words}) <= 3 and not (len({words}) = 1 and lower({strip(name)}) in ({quoted(V.NO_NAMES)})) and {fits}"
    s = _replaced(f"case when {named} then regexp_replace({s}, {text(X.NAME_PREFIX)}, '') else {s} end", (X.NAME_INSIDE, " "))
    kept = f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> '' and regexp_replace(lower(w), '[^a-z'']', '', 'g') not in ({quoted(V.HESITATIONS)}))"
    return f"array_to_string({kept}, ' ')"


def unique(table: str, key: str, columns: str) -> str:
    """The rows of a table with repeated keys dropped (their other columns are equal)."""
    return f"(select {key}, {', '.join(f'any_value({c}) {c}' for c in columns.split())} from {table} group by {key})"
