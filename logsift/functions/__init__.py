from .levels import extract_level, level_from_priority, level_from_substrings, level_from_words
from .network import (NETWORK_INFO_FIELDS, ip_addresses, mac_addresses, network_info, ports,
                      protocol_name, protocols)
from .text import (day_of_week, hour_bucket_text, hour_label, is_error, mask, masked_message,
                   readable_size, short_md5_id, status_class, tokens, truncate_text)

__all__ = [
    "extract_level", "level_from_priority", "level_from_substrings", "level_from_words",
    "NETWORK_INFO_FIELDS", "ip_addresses", "mac_addresses", "network_info", "ports",
    "protocol_name", "protocols", "day_of_week", "hour_bucket_text", "hour_label", "is_error",
    "mask", "masked_message", "readable_size", "short_md5_id", "status_class", "tokens",
    "truncate_text",
]
