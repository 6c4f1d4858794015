"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from .common import table


def op1(spark, sf_dir):
    from .language import op1_language

    return op1_language(table(spark, sf_dir, "documents"))


def op2(spark, sf_dir):
    from .extract import op2_html

    return op2_html(table(spark, sf_dir, "pages"))


def op3(spark, sf_dir):
    from .pieces import op3_pieces

    return op3_pieces(table(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    from .toxicity import op4_toxicity

    return op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark, sf_dir):
    from .decontaminate import op5_decontamination

    return op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6(spark, sf_dir):
    from .quality import op6_quality

    return op6_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7(spark, sf_dir):
    from .pii import op7_pii

    return op7_pii(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    from .vectors import op8_vectors

    return op8_vectors(table(spark, sf_dir, "embeddings"))


def op9(spark, sf_dir):
    from .repeats import op9_repeats

    return op9_repeats(table(spark, sf_dir, "documents"))


def op10(spark, sf_dir):
    from .jaccard import op10_jaccard

    return op10_jaccard(table(spark, sf_dir, "documents"))


def op11(spark, sf_dir):
    from .search import op11_search

    return op11_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark, sf_dir):
    from .lines import op12_lines

    return op12_lines(table(spark, sf_dir, "documents"))


def op13(spark, sf_dir):
    from .middle import op13_middle

    return op13_middle(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_crf": op1,
    "op2_html_tree": op2,
    "op3_pieces_sampled": op3,
    "op4_toxicity_counterfactual": op4,
    "op5_decontamination_lsa": op5,
    "op6_quality_neighbours": op6,
    "op7_pii_skip_chain": op7,
    "op8_vectors_flat_graph": op8,
    "op9_suffix_repeats": op9,
    "op10_jaccard_parity": op10,
    "op11_wavelet_search": op11,
    "op12_line_runs": op12,
    "op13_middle_arrow": op13,
    "pipeline": pipeline,
}

COMPONENTS = "r(id, c) as (select id, id from nodes union select p.b, r.c from r join p on r.id = p.a)"

OP8 = f"""with recursive v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x::double))) > 0),
 nodes as (select vec_id as id from embeddings), p as (select a.id as a, b.id as b from v a join v b on a.id <> b.id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9), {COMPONENTS},
 n as (select a, count(*) as n from p group by a), c as (select id, min(c) as c from r group by id)
 select c.id as vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, c.id = c.c as kept from c left join n on n.a = c.id"""

OP9 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), n as (select doc_id, h, len(h) // 2 as n from d),
 g as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, n - 49)) as i from n where n >= 50)),
 f as (select g, min(doc_id) as m from g group by g having min(doc_id) < max(doc_id)), m as (select distinct g.doc_id, i from g join f on g.g = f.g where f.m < g.doc_id),
 l as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from m), s as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as k from l),
 runs as (select doc_id, k, min(i) as a, max(i) + 50 as b from s group by doc_id, k), w as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as was from runs),
 c as (select w.doc_id, sum(b - a)::bigint as gone, count(*) as spans, max(b) as last_b, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' order by a) as kept from w join n on n.doc_id = w.doc_id group by w.doc_id)
 select n.doc_id, n.n::bigint as n_bytes, coalesce(gone, 0) as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(case when c.doc_id is null then h else kept || substr(h, 2 * last_b + 1) end)) as kept_sha256 from n left join c on c.doc_id = n.doc_id"""

OP10 = f"""with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ') || '  '] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from t),
 x as (select doc_id, len(s) as n, unnest(s) as g from s), p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
 nodes as (select doc_id as id from documents), {COMPONENTS}, c as (select id, min(c) as c from r group by id)
 select s.doc_id, len(s.s)::bigint as n_shingles, c.c as component_id from s join c on c.id = s.doc_id"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TERMS = "unnest(regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w".format(LOWER.format("coalesce(text, '')"))

OP11 = f"""with t as (select doc_id, w, count(*) as tf from (select doc_id, {TERMS} from documents) group by doc_id, w),
 d as (select doc_id, sum(tf)::bigint as n from t group by doc_id), c as (select count(*) as docs, sum(n)::bigint as len from d),
 f as (select w, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from t, c group by w, docs),
 i as (select t.doc_id, t.w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))) as x from t join d on d.doc_id = t.doc_id join f on f.w = t.w, c),
 q as (select item_id, w, count(*) as times from (select item_id, {TERMS} from benchmark) group by item_id, w),
 s as (select item_id, doc_id, sum(times * x)::bigint as score from q join i on q.w = i.w group by item_id, doc_id having sum(times * x) > 0)
 select item_id, rank::integer as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 10"""

OP12 = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
 x as (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as i from d), k as (select *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from x),
 b as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
 m as (select k.doc_id, line, i, b.key is not null and k.doc_id <> b.top as gone from k left join b on b.key = k.key)
 select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""

OP13 = """with h as (select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id::varchar) as h from documents),
 x as (select doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from h),
 c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from x),
 p as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from c)
 select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(pre || mid || suf) as restored_sha256 from p"""

ORACLE: dict[str, str] = {"op11_wavelet_search": OP11, "op12_line_runs": OP12, "op13_middle_arrow": OP13, "op8_vectors_flat_graph": OP8, "op9_suffix_repeats": OP9, "op10_jaccard_parity": OP10}
