"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import media, mixing, packing, quality, secrets, simhash, substring, token_files, toxicity, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_pack": packing.op2_pack,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_substring": substring.op5_substring,
    "op6_secrets": secrets.op6_secrets,
    "op7_simhash": simhash.op7_simhash,
    "op8_mix": mixing.op8_mix,
    "op9_media": media.op9_media,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op3_warc": warc.OP3_SQL,
    "op5_substring": substring.OP5_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op9_media": media.OP9_SQL,
}
