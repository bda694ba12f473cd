"""Schemas of the nested documents."""

from __future__ import annotations

_TITLE = "array<struct<rol:string,tipo:string,titulo:string,fecha:string,enlace:string>>"

PROFILE = f"""id string, nombre string, nombre_completo string, facultad_csv string, cargo_csv string,
    cargo_principal string, areas_investigacion array<string>, perfil_profesional string,
    publicaciones {_TITLE}, total_publicaciones bigint, proyectos {_TITLE},
    enlaces_externos map<string,string>, identidad map<string,array<string>>,
    cvlac struct<url:string,cod_rh:string,datos_generales:map<string,string>,
      lineas_investigacion:array<string>,areas_actuacion:array<string>,proyectos:array<string>,articulos:array<string>>"""

EXTRACTION = """convocatoria string, objetivo string,
    actores_elegibles array<struct<tipo:string,rol:string,condicion:string>>,
    alianza_obligatoria boolean,
    lineas_tematicas array<struct<nombre:string,modalidad:string,descripcion_corta:string>>,
    requisitos array<struct<texto:string,tipo:string,severidad:string>>,
    causales_rechazo array<struct<texto:string>>,
    criterios_evaluacion array<struct<nombre:string,puntaje_max:double,peso_pct:double,descripcion:string>>,
    financiacion struct<monto_total_texto:string,monto_total_cop:double,plazo_min_meses:int,plazo_max_meses:int,
      contrapartida_pct_min:double,contrapartida_pct_max:double,fuente_recursos:string,notas:string>"""

# Open-data column names of an award line and the library's names.
AWARD_COLUMNS = {
    "id_del_proceso": "process_id",
    "referencia_del_proceso": "process_reference",
    "entidad": "buyer",
    "nit_entidad": "buyer_tax_id",
    "departamento_entidad": "buyer_department",
    "ciudad_entidad": "buyer_city",
    "adjudicado": "awarded_text",
    "adjudicado_bool": "awarded_flag",
    "valor_total_adjudicacion": "value",
    "precio_base": "base_price",
    "nit_del_proveedor_adjudicado": "supplier_tax_id",
    "nombre_del_proveedor": "supplier_name",
    "departamento_proveedor": "department",
    "ciudad_proveedor": "city",
    "fecha_de_publicacion_del": "published_at",
    "fecha_adjudicacion": "awarded_at",
    "segmento_unspsc": "segment",
    "codigo_principal_de_categoria": "category_code",
    "modalidad_de_contratacion": "method",
    "nombre_del_procedimiento": "title",
    "urlproceso": "url",
    "estado_del_procedimiento": "state",
    "estado_resumen": "state_summary",
    "duracion": "duration",
    "numero_de_lotes": "lots",
}
MONEY = ("value", "base_price")
NUMBERS = ("duration", "lots")
DATES = ("published_at", "awarded_at")
