"""Results of the operators that SQL can express, for DuckDB over the same tables."""

# Everything linked with a node, by any path; links go both ways.
_REACHED = """
    reached as (select id, id as other from nodes
                union select r.id, l.b from reached r join links l on l.a = r.other)"""



def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks round by round; p numbers the part positions, e the entries, x holds the components."""
    steps = [f"""
        kept as materialized (
          select vec_id, label, row_number() over (order by vec_id, embedding) - 1 as rid,
                 [cast(floor(4096 * cast(x as double)) as bigint) for x in embedding] v
          from embeddings
          where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        cut as materialized (
          select rid, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] x
          from kept, range({parts}) positions(p)),
        book0 as materialized (select p, rid as e, x from cut where rid < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} as materialized (
          select rid, any_value(c.vec_id) vec_id, any_value(c.label) label, c.p, any_value(c.x) x,
                 min([list_sum([(c.x[i] - b.x[i]) * (c.x[i] - b.x[i]) for i in range(1, len(b.x) + 1)]), b.e]) best
          from cut c join book{k} b on c.p = b.p group by c.rid, c.p)""")
        if k < rounds:
            steps.append(f"""
        sums{k} as (select p, best[2] e, i, sum(x[i]) s, count(*) c from near{k}, range(1, {64 // parts + 1}) places(i) group by all),
        means{k} as (select p, e, list(cast((s - ((s % c) + c) % c) // c as bigint) order by i) x from sums{k} group by 1, 2),
        book{k + 1} as materialized (select b.p, b.e, coalesce(m.x, b.x) x from book{k} b left join means{k} m on m.p = b.p and m.e = b.e)""")
    return f"""
        with {','.join(steps)},
        coded as (
          select rid, any_value(vec_id) vec_id, any_value(label) label, cast(sum(best[1]) as bigint) error,
                 string_agg(format('{{:02x}}', cast(best[2] as int)), '' order by p) code
          from near{rounds} group by rid)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256
        from coded"""


ORACLES = {
    "op7_int8_tile_dedup": f"""
        with recursive usable as (
          select vec_id, label, cast(embedding as double[]) e from embeddings
          where label is not null and vec_id is not null and len(embedding) > 0
            and len([x for x in embedding if x is null or not isfinite(x)]) = 0
            and len([x for x in embedding if x <> 0]) > 0),
        sized as (select *, sqrt(list_dot_product(e, e)) size from usable),
        links as (select x.vec_id a, y.vec_id b from sized x join sized y on x.label = y.label and x.vec_id <> y.vec_id
                  where list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.98),
        nodes as (select vec_id as id from embeddings),
        {_REACHED},
        counted as (select a, count(*) n from links group by 1),
        grouped as (select id, min(other) component_id from reached group by 1)
        select g.id as vec_id, coalesce(c.n, 0) as n_links, g.component_id, g.id = g.component_id as kept
        from grouped g left join counted c on c.a = g.id""",
    "op9_suffix_array_html": r"""
        with inside as (
          select page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') part from pages),
        plain as (
          select page_id, url, regexp_replace(regexp_replace(part, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') part from inside),
        decoded as (
          select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(part, '&lt;', '<'), '&gt;', '>'),
                 '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '[\s\p{Zs}]+', ' ', 'g')) as text from plain)
        select page_id, url, text, cast(length(text) as bigint) as n_chars from decoded""",
    "op10_bbit_minhash": rf"""
        with recursive worded as (
          select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') w from documents),
        sets as (
          select doc_id, case when len(w) = 0 or w is null then [] when len(w) < 3 then [array_to_string(w, ' ')]
                 else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end s
          from worded),
        members as (select doc_id, len(s) n, unnest(s) t from sets),
        common as (select x.doc_id a, y.doc_id b, any_value(x.n) n, any_value(y.n) m, count(*) k
                   from members x join members y on x.t = y.t and x.doc_id <> y.doc_id group by 1, 2),
        links as (select a, b from common where 100 * k >= 85 * (n + m - k)),
        nodes as (select doc_id as id from documents),
        {_REACHED},
        grouped as (select id, min(other) component_id from reached group by 1)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, g.component_id, s.doc_id = g.component_id as kept
        from sets s join grouped g on g.id = s.doc_id""",
    "op11_walsh_hadamard_codes": _codes(),
    "op12_url_trie": r"""
        with rules(host, path, verdict) as (values
          ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        after as (select row_number() over () r, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end s from pages),
        split as (select r, page_id, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                         regexp_extract(s, '^[^/?#]*([^?#]*)', 1) path from after),
        fits as (select r, max_by(struct_pack(rule := u.host || u.path, verdict := u.verdict), length(u.host || u.path)) best
                 from split s join rules u on (s.host = u.host or s.host like '%.' || u.host) and starts_with(s.path, u.path) group by r)
        select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
        from split left join fits using (r)""",
    "op13_dynamic_phrase_counting": r"""
        with pieces as (
          select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
          from documents where text is not null),
        worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
        grams as (
          select lang, 1 k, unnest(w) phrase from worded
          union all select lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) from worded
          union all select lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) from worded),
        counted as materialized (select lang, k, phrase, count(*) a from grams group by all having count(*) >= 10),
        totals as (select lang, count(*) n from grams where k = 1 group by lang),
        cuts as (
          select lang, k, phrase, a, string_split(phrase, ' ') w, unnest(range(1, k)) cut from counted where k > 1),
        scored as (
          select c.lang, c.phrase, c.a, cut, x.a l, y.a r, (1000000 * c.a::hugeint * c.a) // (x.a::hugeint * y.a) score
          from cuts c join counted x on x.lang = c.lang and x.phrase = array_to_string(w[1 : cut], ' ')
          join counted y on y.lang = c.lang and y.phrase = array_to_string(w[cut + 1 :], ' ')),
        least as (select lang, phrase, a, min_by(struct_pack(l := l, r := r, score := score), (score, cut)) b from scored group by 1, 2, 3),
        inside as (
          select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) phrase, a
          from (select lang, string_split(phrase, ' ') w, a from counted where k = 3)),
        covers as (select lang, phrase, max(a) longer from inside group by 1, 2),
        ranked as (
          select lang, row_number() over (partition by lang order by b.score desc, a desc, phrase) "rank", phrase, a, b.l l, b.r r, b.score::bigint score
          from least left join covers using (lang, phrase) where longer is null or 100 * longer < 50 * a)
        select lang, "rank", phrase, a, l, r, n, score from ranked join totals using (lang) where "rank" <= 2000""",
}
