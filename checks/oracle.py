"""The same results in SQL, written from the definitions and run by DuckDB.

Nothing is shared with the Spark side but literal word lists.
"""

from __future__ import annotations

from pairlens.functions.stops import ENGLISH_STOPS, INTERROGATIVES

SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"
STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOPS) + ")"

PAIRS = r"""
docs AS MATERIALIZED (SELECT doc_id, coalesce(text, ' ') AS text FROM documents),
doc_lines AS (SELECT DISTINCT doc_id, line FROM (
    SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM docs) WHERE length(line) >= 40),
links AS (
    SELECT a.doc_id AS id1, b.doc_id AS id2 FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1 OR b.doc_id = a.doc_id + 7
    UNION
    SELECT g.first_id, d.doc_id FROM docs d
    JOIN (SELECT md5(text) AS k, min(doc_id) AS first_id FROM docs GROUP BY 1) g ON md5(d.text) = g.k
    WHERE d.doc_id > g.first_id
    UNION
    SELECT g.first_id, l.doc_id FROM doc_lines l
    JOIN (SELECT line, min(doc_id) AS first_id FROM doc_lines GROUP BY 1) g ON l.line = g.line
    WHERE l.doc_id > g.first_id),
doc_words AS MATERIALIZED (
    SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '""" + SPACE + r"""'), lambda x: x <> '')) AS ws FROM docs),
paired AS (
    SELECT id1 * 2147483648 + id2 AS id, id1, id2, a.text AS question1, b.text AS question2,
           len(list_intersect(wa.ws, wb.ws)) AS shared, len(wa.ws) + len(wb.ws) AS total
    FROM links JOIN docs a ON a.doc_id = id1 JOIN docs b ON b.doc_id = id2
    JOIN doc_words wa ON wa.doc_id = id1 JOIN doc_words wb ON wb.doc_id = id2),
pairs AS MATERIALIZED (
    SELECT id, id1, id2, question1, question2,
           CASE WHEN total > shared AND shared / (total - shared) >= 0.5 THEN 1 ELSE 0 END::BIGINT AS is_duplicate,
           CASE WHEN substr(md5('fx' || id), 1, 2) < '1a' THEN 'test' ELSE 'train' END AS split
    FROM paired),
cells AS (SELECT id, 1 AS side, question1 AS text, split FROM pairs
          UNION ALL SELECT id, 2, question2, split FROM pairs)"""


def with_pairs(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((PAIRS, *ctes)) + "\n" + select


def r6(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


# Text and token expressions -------------------------------------------------------------------

def split_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda w: w <> '')"


def no_stops(words: str) -> str:
    return f"list_filter({words}, lambda w: w NOT IN {STOPS})"


def synonyms(text: str) -> str:
    return f"replace(replace({text}, ' usa ', ' america '), ' uk ', ' england ')"


def contractions(text: str) -> str:
    for old, new in (("what's", "what is"), ("'s", " "), ("'ve", " have "), ("can't", "cannot "), ("n't", " not "),
                     ("i'm", "i am"), ("'re", " are "), ("'d", " would "), ("'ll", " will "), ("e-mail", "email")):
        text = "replace({}, '{}', '{}')".format(text, old.replace("'", "''"), new)
    return text


def cleaned(text: str, stops: bool = True, first: bool = False) -> str:
    words = split_words(f"lower({text})")
    body = f"list_aggregate({no_stops(words) if stops else words}, 'string_agg', ' ')"
    body = f"coalesce({body}, '')"
    if first:
        body = contractions(body)
    return synonyms(f"regexp_replace({body}, '[^A-Za-z0-9]', ' ', 'g')")


def clean_words(text: str) -> str:
    return split_words(cleaned(text))


def runs(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+(?:[-''][\p{{L}}\p{{N}}_]+)*', 0)"


def alpha(text: str) -> str:
    return rf"list_filter({no_stops(runs(text))}, lambda w: regexp_matches(w, '^\p{{L}}+$'))"


def terms(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}', 0)"


def sequence_words(text: str) -> str:
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    return (f"list_filter(string_split(translate(lower({text}), '{marks}' || chr(9) || chr(10), "
            f"repeat(' ', {len(marks) + 2})), ' '), lambda w: w <> '')")


def plain(text: str) -> str:
    return no_stops(split_words(f"lower({text})"))


def grams(words: str) -> str:
    """Words and neighbours, `words` being a column name."""
    return (f"list_concat({words}, list_transform(range(1, len({words})), "
            f"lambda i: {words}[i] || ' ' || {words}[i + 1]))")


def normal(text: str) -> str:
    kept = rf"regexp_replace({text}, '[\x{{80}}-\x{{FF}}]', '', 'g')"
    return rf"trim(lower(regexp_replace({kept}, '[^\p{{L}}\p{{N}}_]', ' ', 'g')))"


def bar(words: str) -> str:
    return f"coalesce(list_aggregate({words}, 'string_agg', '|'), '')"


def per_text(expr) -> str:
    return with_pairs(f"SELECT id, {expr('question1')} AS out1, {expr('question2')} AS out2 FROM pairs")


ORACLE: dict[str, str] = {
    "clean_text": per_text(cleaned),
    "clean_text_contractions_first": per_text(lambda t: cleaned(t, first=True)),
    "clean_text_with_stop_words": per_text(lambda t: cleaned(t, stops=False)),
    "clean_tokens": per_text(lambda t: bar(clean_words(t))),
    "stop_filter": per_text(lambda t: bar(plain(t))),
    "contraction_rewrites": per_text(lambda t: contractions(f"lower({t})")),
    "synonym_rewrites": per_text(lambda t: synonyms(f"lower({t})")),
    "alpha_words": per_text(lambda t: bar(alpha(t))),
    "term_tokens": per_text(lambda t: bar(terms(t))),
    "sequence_tokens": per_text(lambda t: bar(sequence_words(t))),
    "token_sort_key": per_text(
        lambda t: f"coalesce(list_aggregate(list_sort({split_words(normal(t))}), 'string_agg', ' '), '')"),
    "bigrams": with_pairs(
        f"SELECT id, {bar(grams('t1'))} AS out1, {bar(grams('t2'))} AS out2 FROM kept",
        f"kept AS (SELECT id, {no_stops(terms('question1'))} AS t1, {no_stops(terms('question2'))} AS t2 FROM pairs)"),
}

# Sources and sinks ----------------------------------------------------------------------------

CAPS = r"length(regexp_replace({}, '\P{{Lu}}', '', 'g'))"
SCORES = "scores AS (SELECT id, is_duplicate, " + ", ".join(
    f"((length(question1) * {i} + length(question2)) % 101) / 101.0::DOUBLE AS fold{i}" for i in range(1, 10)) + (
    ", CASE WHEN length(question1) % 5 <> 0 THEN (length(question2) % 97) / 97.0::DOUBLE END AS score FROM pairs)")
# A text is taken apart once, however many cells hold it.
COUNTS = ("counts AS MATERIALIZED (SELECT word, sum(mentions)::BIGINT AS cnt FROM (SELECT mentions, unnest({}) AS word FROM "
          "(SELECT text, count(*) AS mentions FROM cells GROUP BY text)) GROUP BY word)")
CLEAN_COUNTS = COUNTS.format(clean_words("text"))
VECTORS = """vectors AS MATERIALIZED (
    SELECT c.word, list_transform(e.embedding, lambda x: x::DOUBLE * (1.0::DOUBLE + 0.25::DOUBLE * (c.idx % 5))) AS vec
    FROM (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS idx FROM counts) c
    JOIN embeddings e ON e.vec_id = c.idx - 1)"""

ORACLE |= {
    "read_pairs_csv": with_pairs(
        "SELECT id, id1, id2, md5(question1) AS q1_md5, md5(question2) AS q2_md5, "
        "CASE WHEN split = 'train' THEN is_duplicate END AS is_duplicate, split FROM pairs"),
    "feature_table_round_trip": with_pairs(
        f"SELECT id, {CAPS.format('question1')} AS caps_count_q1, contains(lower(question1), 'how')::BIGINT AS q1_how FROM pairs"),
    "feature_table_csv": with_pairs(
        f"SELECT id, {CAPS.format('question1')} - {CAPS.format('question2')} AS diff_caps, "
        "contains(lower(question1), 'why')::BIGINT * contains(lower(question2), 'why')::BIGINT AS why_both FROM pairs"),
    "write_predictions": with_pairs(f'SELECT id AS "Id", {r6("fold1")} AS "Score" FROM scores', SCORES),
    "write_members": with_pairs(
        "SELECT id, " + ", ".join(f"{r6(f'fold{i}')} AS fold{i}" for i in range(1, 10)) + " FROM scores", SCORES),
    "read_word_vectors_text": with_pairs(
        f"SELECT word, generate_subscripts(vec, 1) - 1 AS pos, {r6('unnest(vec)::FLOAT::DOUBLE')} AS x FROM vectors",
        CLEAN_COUNTS, VECTORS),
}

# Characters and words -------------------------------------------------------------------------


def surface() -> str:
    c1, c2 = CAPS.format("question1"), CAPS.format("question2")
    cols = [f"{c1} AS caps_count_q1", f"{c2} AS caps_count_q2", f"{c1} - {c2} AS diff_caps"]
    for w in INTERROGATIVES:
        a, b = (f"contains(lower(question{n}), '{w}')::BIGINT" for n in (1, 2))
        cols += [f"{a} AS q1_{w}", f"{b} AS q2_{w}", f"{a} * {b} AS {w}_both"]
    return ", ".join(cols)


def smaller_over_larger(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN least({a}, {b}) / greatest({a}, {b}) END"


SETS = (f"tokens AS MATERIALIZED (SELECT id, {clean_words('question1')} AS a, {clean_words('question2')} AS b FROM pairs)",
        f"sets AS MATERIALIZED (SELECT id, a, b, list_distinct(a) AS sa, list_distinct(b) AS sb, "
        f"list_distinct({no_stops('a')}) AS ra, list_distinct({no_stops('b')}) AS rb FROM tokens)",
        "sizes AS (SELECT *, length(array_to_string(a, '')) AS ca, length(array_to_string(b, '')) AS cb, "
        "length(array_to_string(ra, '')) AS cra, length(array_to_string(rb, '')) AS crb FROM sets)")
WORD_SET = f"""
    abs(len(a) - len(b)) AS wc_diff, {smaller_over_larger('len(a)', 'len(b)')} AS wc_ratio,
    abs(len(sa) - len(sb)) AS wc_diff_unique, {smaller_over_larger('len(sa)', 'len(sb)')} AS wc_ratio_unique,
    abs(len(ra) - len(rb)) AS wc_diff_unq_stop, {smaller_over_larger('len(ra)', 'len(rb)')} AS wc_ratio_unique_stop,
    CASE WHEN len(a) > 0 AND len(b) > 0 THEN (a[1] = b[1])::BIGINT END AS same_start,
    abs(ca - cb) AS char_diff, abs(cra - crb) AS char_diff_unq_stop,
    len(list_intersect(sa, sb)) AS common_words, len(list_distinct(list_concat(sa, sb))) AS total_unique_words,
    len(list_distinct(list_concat(ra, rb))) AS total_unq_words_stop, {smaller_over_larger('ca', 'cb')} AS char_ratio"""
WEIGHTS = "weights AS (SELECT word, CASE WHEN cnt < 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (cnt + 10000) END AS weight FROM counts)"
MATCH = (
    """in_pair AS (SELECT id, word, max(side1) AS in1, max(side2) AS in2 FROM (
        SELECT id, unnest(sa) AS word, 1 AS side1, 0 AS side2 FROM sets
        UNION ALL SELECT id, unnest(sb), 0, 1 FROM sets) GROUP BY id, word)""",
    f"""match_sums AS (SELECT id,
        sum(CASE WHEN in1 + in2 = 2 THEN 2 * weight ELSE 0 END) AS num, sum((in1 + in2) * weight) AS den,
        sum(CASE WHEN in1 + in2 = 2 AND word NOT IN {STOPS} THEN 2 * weight ELSE 0 END) AS num_stop,
        sum(CASE WHEN word NOT IN {STOPS} THEN (in1 + in2) * weight ELSE 0 END) AS den_stop
        FROM in_pair JOIN weights USING (word) GROUP BY id)""",
    f"""shares AS (SELECT id,
        CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0 WHEN den <> 0 THEN {r6('num / den')} END AS tfidf_wm,
        CASE WHEN len(ra) = 0 OR len(rb) = 0 THEN 0 WHEN den_stop <> 0 THEN {r6('num_stop / den_stop')} END AS tfidf_wm_stops
        FROM sets LEFT JOIN match_sums USING (id))""")

MAPPED = ("norms AS (SELECT word, left(word, length(word) - 1) AS norm FROM counts WHERE length(word) >= 5 AND suffix(word, 's'))",
          f"token_rows AS (SELECT id, side, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM "
          f"(SELECT id, side, {clean_words('text')} AS ws FROM cells))",
          "mapped AS (SELECT id, side, string_agg(coalesce(norm, t.word), '|' ORDER BY pos) AS words "
          "FROM token_rows t LEFT JOIN norms n ON n.word = t.word GROUP BY id, side)")


def two_sides(table: str, column: str) -> str:
    return (f"SELECT id, coalesce(s1.{column}, '') AS out1, coalesce(s2.{column}, '') AS out2 FROM pairs "
            f"LEFT JOIN (SELECT * FROM {table} WHERE side = 1) s1 USING (id) "
            f"LEFT JOIN (SELECT * FROM {table} WHERE side = 2) s2 USING (id)")


ORACLE |= {
    "surface_features": with_pairs(f"SELECT id, {surface()} FROM pairs"),
    "word_set_features": with_pairs(f"SELECT id, {WORD_SET} FROM sizes", *SETS),
    "fill_zero": with_pairs(
        "SELECT id, coalesce(wc_ratio, 0) AS wc_ratio, coalesce(same_start, 0) AS same_start, "
        f"coalesce(char_ratio, 0) AS char_ratio FROM (SELECT id, {WORD_SET} FROM sizes)", *SETS),
    "word_match_share": with_pairs("SELECT * FROM shares", CLEAN_COUNTS, WEIGHTS, *SETS, *MATCH),
    "map_tokens": with_pairs(two_sides("mapped", "words"), CLEAN_COUNTS, *MAPPED),
}

# Corpus ---------------------------------------------------------------------------------------

TERMS = (f"term_rows AS (SELECT id, side, unnest({grams('ws')}) AS term FROM "
         f"(SELECT id, side, {no_stops(terms('text'))} AS ws FROM cells))",
         "tf AS MATERIALIZED (SELECT id, side, term, count(*) AS tf FROM term_rows GROUP BY id, side, term)",
         "df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term)")
TFIDF = (*TERMS,
         "w AS MATERIALIZED (SELECT id, side, term, tf * (ln((1.0 + n)::DOUBLE / (1.0 + df)) + 1) AS w "
         "FROM tf JOIN df USING (term), (SELECT count(*) AS n FROM cells))",
         "norms AS (SELECT id, side, sqrt(sum(w * w)) AS norm, sum(w) AS total, count(*) AS n, max(w) AS hi, min(w) AS lo "
         "FROM w GROUP BY id, side)")
TFIDF_FEATURES = (
    "SELECT id, " + ", ".join(
        f"coalesce({r6(f's{s}.total / s{s}.norm')}, 0) AS z_tfidf_sum{s}, "
        f"coalesce({r6(f's{s}.total / s{s}.norm / s{s}.n')}, 0) AS z_tfidf_mean{s}, coalesce(s{s}.n, 0) AS z_tfidf_len{s}"
        for s in (1, 2)) +
    " FROM pairs LEFT JOIN (SELECT * FROM norms WHERE side = 1) s1 USING (id) "
    "LEFT JOIN (SELECT * FROM norms WHERE side = 2) s2 USING (id)")
SEQUENCE_COUNTS = COUNTS.format(sequence_words("text"))
VOCABULARY = "vocabulary AS MATERIALIZED (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS idx FROM counts)"


def sequences() -> str:
    return (f"sequences AS (SELECT id, side, list(v.idx ORDER BY pos) AS seq FROM ("
            f"SELECT id, side, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM "
            f"(SELECT id, side, {sequence_words('text')} AS ws FROM cells)) t "
            f"JOIN vocabulary v ON v.word = t.word GROUP BY id, side), "
            "shown AS (SELECT id, side, array_to_string(seq, ' ') AS words, "
            "array_to_string(list_concat(list_transform(range(greatest(0, 40 - len(seq))), lambda i: 0), "
            "seq[-40:]), ' ') AS padded FROM sequences)")


ZEROS = " ".join(["0"] * 40)
ORACLE |= {
    "corpus_word_counts": with_pairs("SELECT word, cnt FROM counts", CLEAN_COUNTS),
    "word_weights": with_pairs(f"SELECT word, cnt, {r6('weight', 12)} AS weight FROM weights JOIN counts USING (word)",
                               CLEAN_COUNTS, WEIGHTS),
    "word_weights_train_only": with_pairs(
        f"SELECT word, cnt, {r6('weight', 12)} AS weight FROM weights JOIN counts USING (word)",
        CLEAN_COUNTS.replace("FROM cells", "FROM cells WHERE split = 'train'"), WEIGHTS),
    "tfidf_fit": with_pairs("SELECT term, df FROM df", *TERMS),
    "tfidf_transform": with_pairs(
        f"SELECT id, side::BIGINT AS side, n AS terms, {r6('total / norm')} AS total, {r6('hi / norm')} AS largest, "
        f"{r6('lo / norm')} AS smallest, 1.0::DOUBLE AS square FROM norms", *TFIDF),
    "tfidf_features": with_pairs(TFIDF_FEATURES, *TFIDF),
    "vocab_index": with_pairs("SELECT word, cnt, idx FROM vocabulary", SEQUENCE_COUNTS, VOCABULARY),
    "texts_to_sequences": with_pairs(two_sides("shown", "words"), SEQUENCE_COUNTS, VOCABULARY, sequences()),
    "pad_sequences": with_pairs(two_sides("shown", "padded").replace("''", f"'{ZEROS}'"),
                                SEQUENCE_COUNTS, VOCABULARY, sequences()),
}

# Graph ----------------------------------------------------------------------------------------

GRAPH = ("keyed AS MATERIALIZED (SELECT id, md5(question1) AS k1, md5(question2) AS k2 FROM pairs)",
         "multi AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM "
         "(SELECT k1 AS src, k2 AS dst FROM keyed UNION ALL SELECT k2, k1 FROM keyed) GROUP BY src, dst)",
         "nodes AS MATERIALIZED (SELECT src AS node, count(*) AS degree, sum(w) AS mentions FROM multi GROUP BY src)")


def rank_rounds(rounds: int = 20) -> tuple[str, ...]:
    steps = ["rank0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"rank{i + 1} AS MATERIALIZED (SELECT m.dst AS node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) "
            f"+ 0.85::DOUBLE * sum(r.rank * m.w / n.mentions) AS rank "
            f"FROM multi m JOIN rank{i} r ON r.node = m.src JOIN nodes n ON n.node = m.src GROUP BY m.dst)")
    return tuple(steps)


ORACLE |= {
    "pair_edges": with_pairs("SELECT DISTINCT src, dst FROM (SELECT k1 AS src, k2 AS dst FROM keyed "
                             "UNION ALL SELECT k2, k1 FROM keyed)", GRAPH[0]),
    "multi_edges": with_pairs("SELECT src, dst, w FROM multi", *GRAPH),
    "neighbour_counts": with_pairs(
        "SELECT id, a.degree AS q1_freq, b.degree AS q2_freq FROM keyed JOIN nodes a ON a.node = k1 "
        "JOIN nodes b ON b.node = k2", *GRAPH),
    "common_neighbours": with_pairs(
        "SELECT id, coalesce(n, 0) AS q1_q2_intersect FROM pairs LEFT JOIN (SELECT id, count(*) AS n FROM keyed "
        "JOIN multi a ON a.src = k1 JOIN multi b ON b.src = k2 AND b.dst = a.dst GROUP BY id) USING (id)", *GRAPH),
    "pagerank": with_pairs(f"SELECT node, {r6('rank', 10)} AS rank FROM rank20", *GRAPH, *rank_rounds()),
    "rank_features": with_pairs(
        f"SELECT id, {r6('a.rank', 10)} AS q1_pr, {r6('b.rank', 10)} AS q2_pr FROM keyed "
        "JOIN rank20 a ON a.node = k1 JOIN rank20 b ON b.node = k2", *GRAPH, *rank_rounds()),
}

# Vectors --------------------------------------------------------------------------------------

SENTENCE = (
    f"hits AS (SELECT id, side, vec FROM (SELECT id, side, unnest({alpha('text')}) AS word FROM cells) JOIN vectors USING (word))",
    "summed AS MATERIALIZED (SELECT id, side, pos, sum(x) AS x FROM "
    "(SELECT id, side, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM hits) GROUP BY id, side, pos)",
    "lengths AS (SELECT id, side, sqrt(sum(x * x)) AS len FROM summed GROUP BY id, side)",
    "scaled AS (SELECT id, side, pos, CASE WHEN len > 0 THEN round(x / len, 9) + 0.0 ELSE 0 END AS x "
    "FROM summed JOIN lengths USING (id, side))",
    "v AS MATERIALIZED (SELECT id, pos, coalesce(a.x, 0)::DOUBLE AS x, coalesce(b.x, 0)::DOUBLE AS y "
    "FROM (SELECT id, unnest(range(64)) AS pos FROM pairs) "
    "LEFT JOIN (SELECT * FROM scaled WHERE side = 1) a USING (id, pos) "
    "LEFT JOIN (SELECT * FROM scaled WHERE side = 2) b USING (id, pos))")


def moment(c: str, which: str) -> str:
    if which == "skew":
        return f"CASE WHEN m2{c} > 0 THEN {r6(f'm3{c} / (m2{c} * sqrt(m2{c}))')} ELSE 0 END"
    return f"CASE WHEN m2{c} > 0 THEN {r6(f'm4{c} / (m2{c} * m2{c}) - 3')} ELSE -3 END"


DISTANCES = (
    "means AS (SELECT id, avg(x) AS mx, avg(y) AS my FROM v GROUP BY id)",
    """sums AS (SELECT id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum(abs(x - y)) AS l1,
        sum((x - y) * (x - y)) AS l2, sum(abs(x - y) * abs(x - y) * abs(x - y)) AS l3,
        count(*) FILTER (x <> 0 OR y <> 0) AS used, count(*) FILTER (x <> y) AS unequal,
        sum(CASE WHEN x <> 0 OR y <> 0 THEN abs(x - y) / (abs(x) + abs(y)) ELSE 0 END) AS canberra, sum(abs(x + y)) AS pooled,
        avg(pow(x - mx, 2)) AS m2x, avg(pow(x - mx, 3)) AS m3x, avg(pow(x - mx, 4)) AS m4x,
        avg(pow(y - my, 2)) AS m2y, avg(pow(y - my, 3)) AS m3y, avg(pow(y - my, 4)) AS m4y
        FROM v JOIN means USING (id) GROUP BY id)""",
    f"""distances AS (SELECT id,
        CASE WHEN xx > 0 AND yy > 0 THEN {r6('1 - xy / (sqrt(xx) * sqrt(yy))')} END AS cosine_distance,
        {r6('l1')} AS cityblock_distance, CASE WHEN used > 0 THEN {r6('unequal / used')} ELSE 0 END AS jaccard_distance,
        {r6('canberra')} AS canberra_distance, {r6('sqrt(l2)')} AS euclidean_distance,
        {r6('pow(l3, 1.0::DOUBLE / 3)')} AS minkowski_distance,
        CASE WHEN pooled > 0 THEN {r6('l1 / pooled')} END AS braycurtis_distance,
        {moment('x', 'skew')} AS skew_q1vec, {moment('y', 'skew')} AS skew_q2vec,
        {moment('x', 'kurtosis')} AS kur_q1vec, {moment('y', 'kurtosis')} AS kur_q2vec FROM sums)""")
UNIT = ("unit AS MATERIALIZED (SELECT word, list_transform(vec, lambda x: x / "
        "sqrt(list_sum(list_transform(vec, lambda z: z * z)))) AS vec FROM vectors)")
BAGS = (f"bags AS MATERIALIZED (SELECT id, side, word, count(*) AS tf FROM "
        f"(SELECT id, side, unnest({plain('text')}) AS word FROM cells) JOIN vectors USING (word) GROUP BY id, side, word)",
        "mass AS (SELECT id, side, sum(tf) AS total FROM bags GROUP BY id, side)")


def moves(name: str, vectors: str) -> str:
    return f"""gaps_{name} AS MATERIALIZED (SELECT a.word AS wa, b.word AS wb,
        CASE WHEN a.word = b.word THEN 0 ELSE list_distance(a.vec, b.vec) END AS gap FROM {vectors} a, {vectors} b),
    met_{name} AS MATERIALIZED (SELECT a.id, wa, wb, a.tf AS tfa, b.tf AS tfb, gap FROM bags a
        JOIN bags b ON b.id = a.id AND b.side = 2 JOIN gaps_{name} ON wa = a.word AND wb = b.word WHERE a.side = 1),
    {name} AS (SELECT id, {r6('greatest(l / m1.total, r / m2.total)')} AS {name} FROM
        (SELECT id, sum(tfa * g) AS l FROM (SELECT id, wa, any_value(tfa) AS tfa, min(gap) AS g FROM met_{name} GROUP BY id, wa) GROUP BY id)
        JOIN (SELECT id, sum(tfb * g) AS r FROM (SELECT id, wb, any_value(tfb) AS tfb, min(gap) AS g FROM met_{name} GROUP BY id, wb) GROUP BY id) USING (id)
        JOIN (SELECT * FROM mass WHERE side = 1) m1 USING (id) JOIN (SELECT * FROM mass WHERE side = 2) m2 USING (id))"""


EMBEDDED = ("sequence_counts AS MATERIALIZED (SELECT word, count(*) AS cnt FROM "
            f"(SELECT unnest({sequence_words('text')}) AS word FROM cells) GROUP BY word)",
            "embedded AS (SELECT row_number() OVER (ORDER BY cnt DESC, s.word) AS idx, s.word, cnt, vec "
            "FROM sequence_counts s LEFT JOIN vectors v ON v.word = s.word)")

ORACLE |= {
    "sentence_vectors": with_pairs("SELECT id, pos, x, y FROM v", CLEAN_COUNTS, VECTORS, *SENTENCE),
    "vector_distances": with_pairs("SELECT * FROM distances", CLEAN_COUNTS, VECTORS, *SENTENCE, *DISTANCES),
    "relaxed_wmd": with_pairs("SELECT id, wmd, norm_wmd FROM pairs LEFT JOIN wmd USING (id) LEFT JOIN norm_wmd USING (id)",
                              CLEAN_COUNTS, VECTORS, UNIT, *BAGS, moves("wmd", "vectors"), moves("norm_wmd", "unit")),
    "unit_vectors": with_pairs(f"SELECT word, generate_subscripts(vec, 1) - 1 AS pos, {r6('unnest(vec)')} AS x FROM unit",
                               CLEAN_COUNTS, VECTORS, UNIT),
    "word_centroid_distance": with_pairs(
        f"SELECT id, {r6('sqrt(gap)')} AS wcd FROM pairs LEFT JOIN (SELECT a.id, sum((a.x - b.x) * (a.x - b.x)) AS gap "
        "FROM centroids a JOIN centroids b ON b.id = a.id AND b.pos = a.pos AND b.side = 2 WHERE a.side = 1 GROUP BY a.id) USING (id)",
        CLEAN_COUNTS, VECTORS, *BAGS,
        "centroids AS MATERIALIZED (SELECT id, side, pos, sum(tf * x) / any_value(total) AS x FROM "
        "(SELECT id, side, tf, total, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM bags JOIN vectors USING (word) "
        "JOIN mass USING (id, side)) GROUP BY id, side, pos)"),
    "embedding_table": with_pairs(
        f"SELECT idx, word, vec IS NULL AS is_oov, 64::BIGINT AS width, {r6('list_sum(vec)')} AS vec_sum FROM embedded",
        CLEAN_COUNTS, VECTORS, *EMBEDDED),
    "embedding_coverage": with_pairs(
        "SELECT count(*) AS words, count(*) FILTER (vec IS NULL) AS oov_words, sum(cnt)::BIGINT AS tokens, "
        "coalesce(sum(cnt) FILTER (vec IS NULL), 0)::BIGINT AS oov_tokens, "
        "count(*) FILTER (list_sum(list_transform(vec, lambda x: abs(x))) = 0) AS zero_vectors FROM embedded",
        CLEAN_COUNTS, VECTORS, *EMBEDDED),
}

# Fuzzy and nouns ------------------------------------------------------------------------------

SPLIT_NORMAL = (f"word_sets AS (SELECT id, list_distinct({split_words(normal('question1'))}) AS a, "
                f"list_distinct({split_words(normal('question2'))}) AS b FROM pairs)",
                "parts AS (SELECT id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS common, "
                "array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS rest1, "
                "array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS rest2 FROM word_sets)")
NOUNS = ("ranked AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS idx FROM counts)",
         f"noun_rows AS MATERIALIZED (SELECT id, side, pos, t.word FROM (SELECT id, side, unnest(ws) AS word, "
         f"generate_subscripts(ws, 1) AS pos FROM (SELECT id, side, {runs('text')} AS ws FROM cells)) t "
         "JOIN ranked r ON r.word = t.word AND r.idx % 3 = 0)",
         "nouns AS (SELECT id, side, string_agg(word, '|' ORDER BY pos) AS words FROM noun_rows GROUP BY id, side)")
RUN_COUNTS = COUNTS.format(runs("text"))

ORACLE |= {
    "token_set_key": with_pairs(
        "SELECT id, common AS key0, trim(common || ' ' || rest1) AS key1, trim(common || ' ' || rest2) AS key2 FROM parts",
        *SPLIT_NORMAL),
    "levenshtein_ratio": with_pairs(
        f"SELECT id, CASE WHEN len = 0 THEN 0 WHEN n1 = n2 THEN 1 ELSE {r6('1 - levenshtein(n1, n2) / len')} END AS ratio FROM "
        "(SELECT id, n1, n2, greatest(length(n1), length(n2)) AS len FROM "
        f"(SELECT id, {normal('question1')} AS n1, {normal('question2')} AS n2 FROM pairs))"),
    "question_nouns": with_pairs(two_sides("nouns", "words"), RUN_COUNTS, *NOUNS),
    "noun_match": with_pairs(
        "SELECT id, coalesce(n, 0) AS noun_match FROM pairs LEFT JOIN (SELECT id, count(*) AS n FROM noun_rows a "
        "WHERE side = 1 AND EXISTS (SELECT 1 FROM noun_rows b WHERE b.id = a.id AND b.side = 2 AND b.word = a.word) "
        "GROUP BY id) USING (id)", RUN_COUNTS, *NOUNS),
}

# Assembly, metrics and blending ---------------------------------------------------------------

SCALED = f"""SELECT id, {', '.join(f'{r6(f"({c} - avg({c}) OVER ()) / CASE stddev_pop({c}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({c}) OVER () END")} AS {c}'
             for c in ('caps_count_q1', 'diff_caps', 'why_both'))}, 0.0::DOUBLE AS constant
             FROM (SELECT id, {surface()} FROM pairs)"""
FINITE = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (
    "wc_ratio", "wc_ratio_unique", "wc_ratio_unique_stop", "same_start", "char_ratio", "tfidf_wm", "tfidf_wm_stops",
    "cosine_distance", "braycurtis_distance"))
FOLDS = [f"fold{i}" for i in range(1, 10)]
LENGTH1, LENGTH2 = "length(question1)", "length(question2)"

ORACLE |= {
    "union_corpus": with_pairs(
        "SELECT split, count(*) AS pairs, (sum(is_duplicate) FILTER (split = 'train'))::BIGINT AS duplicates FROM pairs GROUP BY split"),
    "assemble_features": with_pairs(
        f"""SELECT * REPLACE ({FINITE}) FROM (SELECT id, is_duplicate, split, {surface()} FROM pairs)
        JOIN (SELECT id, {WORD_SET} FROM sizes) USING (id) JOIN shares USING (id)
        JOIN (SELECT id, a.degree AS q1_freq, b.degree AS q2_freq FROM keyed JOIN nodes a ON a.node = k1 JOIN nodes b ON b.node = k2) USING (id)
        JOIN distances USING (id)""",
        CLEAN_COUNTS, WEIGHTS, *SETS, *MATCH, *GRAPH, VECTORS, *SENTENCE, *DISTANCES),
    "finite_or_zero": with_pairs(
        f"SELECT id, CASE WHEN {LENGTH1} % 7 > 3 THEN {r6(f'{LENGTH1} / {LENGTH2}')} ELSE 0 END AS value FROM pairs"),
    "standard_scale": with_pairs(SCALED),
    "null_audit": with_pairs(
        "SELECT " + ", ".join(f"max(({c} IS NULL)::BIGINT) AS {c}" for c in (
            "wc_diff", "wc_ratio", "wc_ratio_unique_stop", "same_start", "char_ratio")) +
        f" FROM (SELECT id, {WORD_SET} FROM sizes)", *SETS),
    "holdout_split": with_pairs("SELECT id, ('0x' || substr(md5(id || '|4242'), 1, 13))::BIGINT < round(0.1 * 4503599627370496)::BIGINT AS is_valid FROM pairs"),
    "symmetric_augment": with_pairs(
        "SELECT id, false AS is_swapped, md5(question1) AS q1_md5, md5(question2) AS q2_md5, is_duplicate, 1.0::DOUBLE AS weight FROM pairs "
        "UNION ALL SELECT id, true, md5(question2), md5(question1), is_duplicate, 1.0::DOUBLE FROM pairs"),
    "log_loss": with_pairs(
        f"SELECT {r6('-avg(is_duplicate * ln(p) + (1 - is_duplicate) * ln(1 - p))')} AS log_loss FROM "
        "(SELECT is_duplicate, greatest(1e-15, least(1 - 1e-15, fold1)) AS p FROM scores)", SCORES),
    "accuracy": with_pairs(f"SELECT {r6('avg(((fold1 > 0.5)::INT = is_duplicate)::INT)')} AS accuracy FROM scores", SCORES),
    "blend": with_pairs(
        f"SELECT id, {r6(f'({' + '.join(FOLDS)} + coalesce(2 * score, 0)) / (9 + CASE WHEN score IS NULL THEN 0 ELSE 2 END)')} AS score FROM scores",
        SCORES),
    "blend_best_confidence": with_pairs(
        f"SELECT id, {r6('arg_max(s, (abs(s - 0.5), -i))')} AS score FROM (SELECT id, unnest([{', '.join(FOLDS)}, score]) AS s, "
        "unnest(range(10)) AS i FROM scores) WHERE s IS NOT NULL GROUP BY id", SCORES),
}
