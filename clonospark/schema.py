"""Fixed schemas of records, queries and hits."""

RECORD_COLUMNS = ["gene", "cdr3", "v", "j", "species", "mhc_a", "mhc_b", "mhc_class", "epitope", "antigen_gene", "antigen_species", "reference_id", "vdjdb_score", "complex_id"]
RECORD_TYPES = {c: "bigint" if c in ("vdjdb_score", "complex_id") else "string" for c in RECORD_COLUMNS}
QUERY_TYPES = {"cdr3": "string", "v": "string", "j": "string", "locus": "string", "count": "bigint", "pair_id": "string"}
HIT_COLUMNS = ["query_cdr3", "query_v", "query_j", "count", "db_cdr3", "db_v", "db_j", "epitope", "mhc_a", "mhc_class", "antigen_species", "vdjdb_score", "complex_id", "score", "n_subs", "n_ins", "n_dels"]

#: Header aliases, most specific first (fixed values of the exchange formats).
RECORD_ALIASES = {
    "gene": ["gene"], "cdr3": ["cdr3", "cdr3aa", "junction_aa"], "v": ["v", "v.segm", "v_gene", "v_call"], "j": ["j", "j.segm", "j_gene", "j_call"],
    "species": ["species"], "mhc_a": ["mhc_a", "mhc.a"], "mhc_b": ["mhc_b", "mhc.b"], "mhc_class": ["mhc_class", "mhc.class"],
    "epitope": ["epitope", "antigen.epitope"], "antigen_gene": ["antigen_gene", "antigen.gene"], "antigen_species": ["antigen_species", "antigen.species"],
    "reference_id": ["reference_id", "reference.id"], "vdjdb_score": ["vdjdb_score", "vdjdb.score", "score"], "complex_id": ["complex_id", "complex.id"],
}
QUERY_ALIASES = {
    "cdr3": ["junction_aa", "cdr3_aa", "cdr3aa", "cdr3", "aminoacid"], "v": ["v_call", "v_gene", "v.segm", "v"], "j": ["j_call", "j_gene", "j.segm", "j"],
    "locus": ["locus", "chain", "gene"], "count": ["duplicate_count", "clone_count", "count", "reads"], "pair_id": ["cell_id", "clone_id", "pair_id", "barcode"],
}
LOCI = {"A": "TRA", "B": "TRB", "alpha": "TRA", "beta": "TRB", "TRA": "TRA", "TRB": "TRB", "TCRA": "TRA", "TCRB": "TRB", "tra": "TRA", "trb": "TRB", "G": "TRG", "D": "TRD", "TRG": "TRG", "TRD": "TRD"}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
