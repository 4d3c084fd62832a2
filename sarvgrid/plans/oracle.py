"""The text rules as DuckDB SQL, written for RE2: contexts are captured where Spark looks around."""

from __future__ import annotations

from ..functions import charclass as C
from ..functions.intent import catalogue

A, NOT_WORD = r"[\x{0600}-\x{06FF}]", r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def unify(text: str) -> str:
    mapped = f"translate(nfc_normalize({text}), '{''.join(C.CHARACTERS)}', '{''.join(C.CHARACTERS.values())}')"
    return f"replace({replace(mapped, r'[\x{064B}-\x{065F}\x{0670}\x{0640}\x{06D6}-\x{06ED}]', '')}, '{C.ZWJ}', '')"


def squeeze(text: str) -> str:
    return f"trim({replace(text, r'[\s\x0b\x{A0}]+', ' ')})"


def analyze(text: str) -> str:
    out = f"replace(translate({unify(text)}, '{C.PERSIAN_DIGITS}{C.ARABIC_DIGITS}', '{C.ASCII_DIGITS * 2}'), '{C.ZWNJ}', '')"
    for p in C.PREFIXES:
        out = replace(out, f"(^|{NOT_WORD})({p}) +({A})", r"\1\2\3")
    for s in C.SUFFIXES:
        out = replace(out, f"({A}) +({s})($|{NOT_WORD})", r"\1\2\3")
    marks = r"[،؛؟!.,;?:\x22\x27()\[\]«»]"
    return f"lower({squeeze(replace(out, marks, ' '))})"


def display(text: str) -> str:
    out = replace(unify(text), r"[ \t]+", " ")
    for p in C.PREFIXES:
        out = replace(out, f"(^|{NOT_WORD})({p})[ {C.ZWNJ}]*({A})", rf"\1\2{C.ZWNJ}\3")
    for s in C.SUFFIXES:
        out = replace(out, f"({A})[ {C.ZWNJ}]*({s})($|{NOT_WORD})", rf"\1{C.ZWNJ}\2\3")
    out = f"CASE WHEN regexp_matches({text}, '{A}') THEN translate({out}, ',;?', '،؛؟') ELSE {replace(unify(text), r'[ \t]+', ' ')} END"
    out = replace(out, r"\s+([،؛؟!.:])", r"\1")
    for _ in range(2):  # marks in a row share the character between them
        out = replace(out, r"([،؛؟!.:])([^\s\p{Nd}])", r"\1 \2")
    return squeeze(f"translate({out}, '{C.ASCII_DIGITS}{C.ARABIC_DIGITS}', '{C.PERSIAN_DIGITS * 2}')")


def content(analyzed: str) -> str:
    return f"list_filter(string_split({analyzed}, ' '), lambda t: t <> '' AND t NOT IN ({quoted(C.STOPWORDS)}))"


def fingerprint(words: str, ordered: bool = False) -> str:
    return f"substr(sha1(array_to_string({words if ordered else f'list_sort({words})'}, ' ')), 1, 16)"


def _intent_of(phrase: str) -> str:
    by: dict[str, list[str]] = {}
    for words, (_, intent) in catalogue().items():
        by.setdefault(intent, []).append(" ".join(words))
    return "CASE " + " ".join(f"WHEN {phrase} IN ({quoted(tuple(v))}) THEN '{k}'" for k, v in by.items()) + " END"


def intents(source: str = "kw") -> str:
    """CTEs an, fi, it: analysed text, content, fired phrases, categories, intent, codes, core."""
    alternatives = "|".join("  ".join(w) for w in catalogue())
    core = "list_transform(list_filter(range(1, len(content) + 1), lambda i: len(list_filter(content[1:i], lambda x: x = content[i])) > len(list_filter(gone, lambda x: x = content[i]))), lambda i: content[i])"
    info = "list_position(kinds, 'informational') > 0 AND list_position(kinds, 'transactional') > 0 AND list_position(kinds, 'informational') < list_position(kinds, 'transactional')"
    return f"""an AS (SELECT *, {analyze("coalesce(text, '')")} AS a FROM {source}),
 fi AS (SELECT *, {content('a')} AS content, list_transform(regexp_extract_all('  ' || replace(a, ' ', '  ') || '  ', ' ({alternatives}) ', 1), lambda s: replace(s, '  ', ' ')) AS fired FROM an),
 ki AS (SELECT *, list_transform(fired, lambda f: {_intent_of('f')}) AS kinds, list_filter(string_split(array_to_string(fired, ' '), ' '), lambda t: t <> '' AND t NOT IN ({quoted(C.STOPWORDS)})) AS gone FROM fi),
 co AS (SELECT *, list_filter([{quoted(C.INTENTS)}], lambda c: list_contains(kinds, c)) AS cats, {core} AS rest, coalesce({info}, false) AS info_first FROM ki),
 it AS (SELECT *, CASE WHEN len(cats) = 0 THEN 'unknown' WHEN len(cats) > 1 AND info_first THEN 'informational' ELSE cats[1] END AS intent,
  CASE WHEN len(cats) = 0 THEN ['intent_unknown'] ELSE list_concat(list_transform(cats, lambda c: 'intent_' || c), CASE WHEN len(cats) > 1 THEN list_concat(['multiple_intent_categories'], CASE WHEN info_first THEN ['informational_precedes_transactional'] ELSE [] END) ELSE [] END) END AS codes,
  CASE WHEN len(rest) > 0 AND len(list_filter(rest, lambda t: t NOT IN ({quoted(C.INSUFFICIENT_CORE)}))) = 0 THEN content ELSE rest END AS core FROM co)"""


def validated() -> str:
    """CTEs up to va: the keyword rows with reason_code."""
    return f"""{intents()},
 nu AS (SELECT *, trim(keyword_id) AS tid, row_number() OVER (PARTITION BY trim(keyword_id), CASE WHEN trim(keyword_id) = '' THEN ordinal END ORDER BY ordinal) AS nth FROM it),
 va AS (SELECT * EXCLUDE (keyword_id), CASE WHEN tid = '' THEN keyword_id ELSE tid END AS keyword_id, CASE WHEN tid = '' THEN 'empty_keyword_id' WHEN nth > 1 THEN 'duplicate_keyword_id' WHEN trim(text) = '' THEN 'empty_keyword_text'
  WHEN search_demand_status NOT IN ({quoted(tuple(C.STATUSES))}) THEN 'invalid_demand_status' WHEN search_demand_status = 'unknown' AND search_demand IS NOT NULL THEN 'demand_status_conflict'
  WHEN search_demand_status <> 'unknown' AND search_demand IS NULL THEN 'missing_search_demand' WHEN search_demand < 0 THEN 'negative_search_demand'
  WHEN len(content) = 0 THEN 'no_content_tokens' WHEN len(core) = 0 THEN 'only_intent_markers' END AS reason_code FROM nu)"""


def ranked() -> str:
    """CTEs up to ra: valid rows with their cluster and rank in it."""
    core = content(analyze("array_to_string(core, ' ')"))
    return f"""{validated()},
 fp AS (SELECT *, {fingerprint('content')} AS fingerprint, {fingerprint(core)} AS topic_core_fingerprint FROM va WHERE reason_code IS NULL),
 ke AS (SELECT *, -(CASE search_demand_status WHEN 'known' THEN 2 WHEN 'estimated' THEN 1 ELSE 0 END) AS k1, CASE WHEN search_demand_status = 'unknown' THEN 1000000000000000000 ELSE -search_demand END AS k2, len(content) AS k3, length(a) AS k4 FROM fp),
 ra AS (SELECT *, row_number() OVER w AS head_rank, lead(k1) OVER w AS n1, lead(k2) OVER w AS n2, lead(k3) OVER w AS n3, lead(k4) OVER w AS n4 FROM ke WINDOW w AS (PARTITION BY topic_core_fingerprint, intent ORDER BY k1, k2, k3, k4, keyword_id))"""


def rejection(text: str) -> str:
    s, e = squeeze(text), r"[«»\x{22}\x{27}()\[\]{}،,؛;:.!?؟۔…\-_/]+"
    bare = f"replace({s}, '{C.ZWNJ}', '')"
    ui = " OR ".join(f"contains({s}, '{p}') OR contains({bare}, '{p}')" for p in C.UI_PHRASES)
    words = f"string_split({s}, ' ')"
    w = r"[\p{L}\p{N}_]"
    clause = "|".join(C.VERBS) + rf"|می{C.ZWNJ}{w}+|مي{w}+|نمى{w}+|نمی{C.ZWNJ}{w}+|{w}+(?:ند|ید|یم|م|ی|د)"
    end = squeeze(replace(s, r"[.!?؟۔…»\x{22}\x{27}]+$", ""))
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN contains({s}, '...') OR contains({s}, '…') OR contains({s}, '|') OR contains({s}, '｜') THEN 'ellipsis_or_pipe'
 WHEN regexp_matches({s}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches({s}, '(?i)https?://|www\\.') THEN 'email_or_url'
 WHEN regexp_matches({s}, '\\p{{Nd}}+\\s*(?:روز|ساعت|دقیقه|هفته|ماه)\\s*(?:قبل|پیش)|دیروز|امروز\\s+ساعت') THEN 'relative_time' WHEN {ui} THEN 'ui_chrome'
 WHEN len(list_filter({words}, lambda t: regexp_matches(t, '{A}'))) < 7 THEN 'too_few_persian_tokens'
 WHEN len(list_filter({words}, lambda t: NOT regexp_matches(regexp_replace(t, '^{e}|{e}$', '', 'g'), '{A}'))) / len({words}) > 0.30 THEN 'non_persian_token_ratio'
 WHEN NOT regexp_matches({end}, '(?:{clause})\\s*[.!?؟۔…]?$') THEN 'no_finite_verb_end' END"""


def labelable(token: str) -> str:
    return rf"(length({token}) > 0 AND NOT regexp_matches({token}, '^(?:[\x00-\x1f\x7f-\x{{9f}}\x{{200c}}-\x{{200f}}]+|[^\p{{L}}\p{{N}}]+|\p{{Nd}}+|[A-Za-z]+)$'))"


def domain(url: str) -> str:
    """Authority of an absolute URL in lower case without www."""
    return f"coalesce(regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), '')"


def skeleton(analyzed: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({analyzed}, ' '), lambda t: t <> ''), lambda t: CASE WHEN t IN ({quoted(C.CLOSED_CLASS)}) OR regexp_matches(t, '^{NOT_WORD}+$') THEN t ELSE '_' END), ' ')"


def template(text: str) -> str:
    return fingerprint(content(analyze(skeleton(analyze(text)))), ordered=True)


def strata(text: str) -> str:
    w, light = r"[\p{L}\p{N}_]", "|".join(C.VERBS[:7])
    number = "|".join(C.UNITS)
    words = f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> ''))"
    return f"""list_filter([CASE WHEN contains({text}, '{C.ZWNJ}') THEN 'zwnj' END, CASE WHEN contains({text}, 'ها') THEN 'plural_ha' END,
 CASE WHEN regexp_matches({text}, 'ی\\s+که|یی(?:\\s|$)|یک\\s+\\S+ی(?:\\s|$)|(?:^|\\s)\\S+ی\\s+را(?:\\s|$)') THEN 'ye_non_ezafe' END, CASE WHEN regexp_matches({text}, '[A-Za-z]') THEN 'latin_brand' END,
 CASE WHEN regexp_matches({text}, '\\p{{Nd}}|{number}') THEN 'number_unit' END,
 CASE WHEN {words} BETWEEN 5 AND 10 AND NOT regexp_matches({text}, '\\s+(?:ی|ِ)\\s+') AND regexp_matches({text}, '(?:{light}|می{C.ZWNJ}{w}+|مي{w}+)\\s*[.!?؟۔]?$') THEN 'no_ezafe_candidate' END], lambda x: x IS NOT NULL)"""


def source_kind(source: str, kind: str, url: str) -> str:
    host = f"CASE WHEN contains({source}, '.') THEN {source} ELSE {domain(url)} END"
    legacy = "CASE {x} WHEN 'wikipedia' THEN 'wiki' WHEN 'fa.wikipedia' THEN 'wiki' WHEN 'news_portal' THEN 'news' WHEN 'blog_portal' THEN 'magazine' WHEN 'shop_mag' THEN 'ecommerce' WHEN 'shop_wiki_stub' THEN 'ecommerce' END"
    by_host = f"CASE WHEN {host} = 'fa.wikipedia.org' THEN 'wiki' WHEN {host} IN ('hamshahrionline.ir', 'isna.ir', 'khabaronline.ir') THEN 'news' WHEN {host} IN ('digiato.com', 'tarafdari.com', 'zoomit.ir') THEN 'magazine' WHEN {host} IN ('digikala.com', 'blog.okala.com', 'okala.com', 'basalam.com', 'emalls.ir', 'torob.com', 'modiseh.com') THEN 'ecommerce' END"
    return f"coalesce(CASE WHEN {kind} IN ('wiki', 'news', 'magazine', 'ecommerce') THEN {kind} END, {legacy.format(x=kind)}, {legacy.format(x=source)}, {by_host}, CASE WHEN contains({source}, 'wikipedia') OR contains({host}, 'wikipedia') THEN 'wiki' END, CASE WHEN {source} = '' AND {kind} = '' AND {url} = '' THEN 'magazine' END)"


def is_wikipedia(source: str, kind: str, url: str) -> str:
    return f"(coalesce(CASE WHEN {kind} <> '' THEN {kind} ELSE {source_kind(source, kind, url)} END = 'wiki', false) OR {source} IN ('fa.wikipedia', 'fa.wikipedia.org') OR contains({source}, 'wikipedia.org'))"


def raw_tokens(text: str) -> str:
    """Words of a text without punctuation at their ends; leading marks don't include those that end sentences."""
    return rf"list_filter(list_transform(regexp_split_to_array(trim({text}), '\s+'), lambda t: regexp_replace(regexp_replace(t, '^[«»\x22\x27()\[\]{{}}،,؛;:…\-_/]+', ''), '[«»\x22\x27()\[\]{{}}،,؛;:.!?؟۔…\-_/]+$', '')), lambda t: t <> '')"


def spans(source: str, tokens: str) -> str:
    """Recursive CTE sp (k, text, tokens, i, pos, spans) of a table (k, text, tokens): spans as text, each found after the one before;
    its rows with i = len(tokens) are whole."""
    at = f"(pos + strpos(substr(text, pos + 1), {tokens}[i + 1]) - 1)"
    return f"""sp AS (SELECT k, text, {tokens}, 0 AS i, 0::BIGINT AS pos, '' AS spans FROM {source} UNION ALL SELECT k, text, {tokens}, i + 1, {at} + length({tokens}[i + 1]), spans || CASE WHEN i > 0 THEN ' ' ELSE '' END || {at} || '-' || ({at} + length({tokens}[i + 1])) FROM sp WHERE i < len({tokens}) AND strpos(substr(text, pos + 1), {tokens}[i + 1]) > 0)"""


def alignment(ours: str, model: str) -> str:
    a, b = f"array_to_string({ours}, '')", f"array_to_string({model}, '')"
    bare = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}\x{{200c}}]+', '', 'g')"
    places = f"len(list_filter(range(1, least(len({ours}), len({model})) + 1), lambda j: contains({ours}[j], '{C.ZWNJ}') <> contains({model}[j], '{C.ZWNJ}'))) > 0"
    return rf"CASE WHEN {ours} = {model} THEN 'aligned' WHEN regexp_matches({a} || {b}, '[.,!?;:،؛؟۔«»\x22\x27()\[\]{{}}…\-_/]') AND {bare(a)} = {bare(b)} THEN 'punctuation' WHEN contains({a}, '{C.ZWNJ}') <> contains({b}, '{C.ZWNJ}') OR {places} THEN 'zwnj' WHEN regexp_matches({a} || {b}, '\p{{Nd}}') THEN 'number' WHEN regexp_matches({a} || {b}, '[A-Za-z]') THEN 'latin' ELSE 'other' END"
