"""SQL of the queries over nested calls (``plans/nested.py``): plain arithmetic on ids and sentence lists."""

from __future__ import annotations

_S = r"""s as (select doc_id as k, n_chars, source, text, list_filter(list_transform(regexp_split_to_array(text, '[.\n]+'), lambda x: trim(x)), lambda x: x <> '') as s from documents),
need as (select k, unnest(range(0, greatest(len(s) - 1, 0))) as i from s)"""
#: Documents as lists of sentences.
SENTENCES = _S.split(",\nneed as")[0]
_KINDS = "(['habilitante', 'documental', 'tecnico', 'otro'])[1 + i % 4]"
_ACTOR = "case k % 3 when 0 then 'Instituciones de Educación Superior (IES)' when 1 then 'Centros de investigación' else 'Universidades públicas' end"
_ALLIANCE = "case k % 3 when 0 then true when 1 then false end"
_AMOUNT = "case when k % 2 = 0 then n_chars * 1e6::double end"

ACTOR_MATCH = f"""with {_S} select 'convocatoria_' || k as convocatoria, {_ACTOR} as tipo,
  case k % 4 when 0 then 'aliado' when 1 then 'ejecutora' when 2 then '' else 'proponente' end as rol from s where k % 11 <> 0 and k % 3 <> 1"""

PENDING = f"""with {_S} select 'convocatoria_' || k as convocatoria, 'Sede en la región y acreditación vigente' as condicion, unnest(['territorio', 'acreditacion']) as riesgo
  from s where k % 11 <> 0 and k % 3 <> 1 and k % 5 = 0"""

REQUIREMENT_TYPES = f"""with {_S} select {_KINDS} as tipo, case when i % 7 = 0 then 'deseable' else 'obligatorio' end as severidad, count(*) as n from need group by 1, 2"""

REPAIR_ITEMS = f"""with {_S}, r as (select k, count(*) as n_in, count(*) filter (where i % 3 <> 2) as n_kept,
    count(*) filter (where i % 3 = 0 or (i % 3 = 1 and i % 4 = 2)) as n_technical from need group by 1)
  select 'convocatoria_' || k as convocatoria, coalesce(n_in, 0)::int as n_in, coalesce(n_kept, 0)::int as n_kept, coalesce(n_technical, 0)::int as n_technical from s left join r using (k)"""

MERGE_PARTIALS = f"""with {_S} select 'convocatoria_' || k as call_id, case when k % 6 <> 0 then s[1] end as objetivo, {_ALLIANCE} as alianza_obligatoria,
    {_AMOUNT} as monto_total_cop, case when k % 5 <> 0 then greatest(len(s) - 1, 0) else 0 end::int as n_requisitos,
    case when k % 11 = 0 then '' else {_ACTOR} end as actores,
    array_to_string(list_filter([case when k % 6 = 0 then 'objetivo' end, case when k % 5 = 0 then 'requisitos' end], lambda x: x is not null), ';') as failed from s"""

QUALITY = f"""with {_S}, n as (select k, (len(s) > 0)::int + (k % 11 <> 0)::int + (len(s) > 0)::int + (len(s) > 1)::int + (len(s) > 0)::int + 1 as n from s)
  select 'convocatoria_' || k as convocatoria, n as fields_populated, n || '/6' as completeness from n"""

BUDGET_ITEMS = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents),
  c as (select doc_id, trim(substr(x, 1, 12)) as item, trim(substr(x, 13)) as description from l)
  select * from c where item <> '' and description <> '' and lower(item) not in ('rubros', 'rubro', 'descripcion')"""

SUMMARY = f"""with {_S}, st as (select *, case when k % 11 = 0 then 0 when k % 3 = 1 then 1 else 2 end as st, k % 4 in (1, 3) or k % 5 = 1 as ex, k % 4 = 0 and k % 5 <> 1 as only_ally, {_ALLIANCE} as al from s)
  select 'convocatoria_' || k as convocatoria, al as alianza_obligatoria, (k % 11 <> 0)::int as n_actores_elegibles, greatest(len(s) - 1, 0)::int as n_requisitos,
    least(len(s), 4)::int as n_criterios_evaluacion, least(len(s), 3)::int as n_lineas_tematicas, length(s[1])::int as objective_chars, {_AMOUNT} as amount,
    case when k % 5 <> 0 then n_chars % 90 end::int as max_months, case st when 1 then false when 2 then true end as puede_postularse,
    case st when 0 then 'desconocido' when 1 then 'no_elegible' else case when only_ally and not ex then 'solo_como_aliado' when al then 'solo_en_alianza' when not al then 'puede_sola_o_alianza' else 'elegible_alianza_indefinida' end end as modo,
    case when st = 2 then case when only_ally and not ex then 'aliado' when ex or k % 4 = 2 then 'ejecutora' else 'aliado' end end as rol_sugerido from st"""

PANORAMA = f"""with {_S} select case when k % 4 = 0 then 'SGR (regalias)' else 'sin_clasificar' end as kind, count(*) as n_calls, avg({_AMOUNT}) as avg_amount, avg(({_ALLIANCE})::int) as alliance_share from s group by 1"""

_CALL = """concat_ws(chr(10), 'Objetivo: ' || nullif(s[1], ''),
  case when len(s) > 0 then 'Líneas temáticas: ' || array_to_string(s[1:3], '; ') end,
  case when len(s) > 1 then 'Requisitos: ' || array_to_string(list_transform(s[2:9], lambda x: substr(x, 1, 180)), '; ') end,
  case when len(s) > 0 then 'Criterios: ' || array_to_string(list_transform(s[1:4], lambda x, i: x || ' (' || (i - 1) * 10 || '.0)'), '; ') end,
  case k % 3 when 0 then 'Alianza obligatoria: sí' when 1 then 'Alianza obligatoria: no' end)"""
_FLAT = rf"trim(regexp_replace({_CALL}, '\s+', ' ', 'g'))"

CANONICAL_TEXT = f"""with {SENTENCES}, c as (select 'convocatoria_' || k as convocatoria, {_FLAT} as t from s)
  select convocatoria, case when t = '' then 'Convocatoria sin texto NLP estructurado' when length(t) > 3500 then substr(t, 1, 3499) || '…' else t end as canonical_text from c"""
