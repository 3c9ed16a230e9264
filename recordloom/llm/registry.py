"""The operators' queries over the standard tables, and SQL for those that SQL can express."""

from . import decontaminate, neardup, ogg, packing, personal, preferences, quality, repair, search, sharding, substrings, suffixes, urlrules

QUERIES = {
    "op1_minhash_dedup": neardup.op1_minhash_dedup,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_ogg_media": ogg.op3_ogg_media,
    "op4_quality": quality.op4_quality,
    "op5_preference_format": preferences.op5_preference_format,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_url_filter": urlrules.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_personal_data": personal.op11_personal_data,
    "op12_lexical_search": search.op12_lexical_search,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLES = {
    "op1_minhash_dedup": neardup.OP1_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op2_sharding": sharding.OP2_SQL,
    "op5_preference_format": preferences.OP5_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_url_filter": urlrules.OP8_SQL,
    "op10_suffix_dedup": suffixes.OP10_SQL,
    "op12_lexical_search": search.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
