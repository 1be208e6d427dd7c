"""Column functions (``Column -> Column``), all built from Spark SQL
built-ins so they stay inside whole-stage codegen."""

from blockyard.functions.colour import (flag_colour, lux_cct, rgb_classify,
                                        rgb_normalise, rgb_pack)
from blockyard.functions.geometry import (assembly_offset, assembly_plan,
                                          block_count, stock_to_robot_offset)
from blockyard.functions.json import (json_decode, json_encode,
                                      nonblank_text_field, safe_epoch,
                                      topic_tag_with_fallback)
from blockyard.functions.text import (enum_normalise, epoch_ms, event_step,
                                      failure_stage, id_defaults,
                                      item_type_from_text, java_trim,
                                      key_partition, nonblank, outcome_message,
                                      reservation_outcome, time_label,
                                      uuid_from_hash, uuid_valid)

__all__ = [n for n in dir() if not n.startswith("_")]
