"""The record layout: names and places of the 180 float32 channels of a one-second record, and the schemas derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

PHASES, STATS = ("a", "b", "c"), ("min", "max", "avg")

# Fixed values of the file format.
MAGIC = bytes.fromhex("4600E802")
RECORD_BYTES = 744
HEADER_BYTES = 24
FLOATS = 180
#: 100 ns ticks between 1601-01-01 and 1970-01-01.
EPOCH_TICKS = 116_444_736_000_000_000


# Fixed values of the file format: the names of the channels in their order, from index 0 on.
_FIRST = [
    "V_LN_a_min_V", "V_LN_a_max_V", "V_LN_a_avg_V", "V_LN_b_min_V", "V_LN_b_max_V", "V_LN_b_avg_V",
    "V_LN_c_min_V", "V_LN_c_max_V", "V_LN_c_avg_V", "V_LL_ab_min_V", "V_LL_ab_max_V", "V_LL_ab_avg_V",
    "V_LL_bc_min_V", "V_LL_bc_max_V", "V_LL_bc_avg_V", "V_LL_ca_min_V", "V_LL_ca_max_V", "V_LL_ca_avg_V",
    "I_a_min_A", "I_a_max_A", "I_a_avg_A", "I_b_min_A", "I_b_max_A", "I_b_avg_A",
    "I_c_min_A", "I_c_max_A", "I_c_avg_A", "V_THD_pct_a_min", "V_THD_pct_a_max", "V_THD_pct_a_avg",
    "V_THD_pct_b_min", "V_THD_pct_b_max", "V_THD_pct_b_avg", "V_THD_pct_c_min", "V_THD_pct_c_max", "V_THD_pct_c_avg",
    "I_THD_pct_a_min", "I_THD_pct_a_max", "I_THD_pct_a_avg", "I_THD_pct_b_min", "I_THD_pct_b_max", "I_THD_pct_b_avg",
    "I_THD_pct_c_min", "I_THD_pct_c_max", "I_THD_pct_c_avg", "freq_min_Hz", "freq_max_Hz", "freq_avg_Hz",
    "P_a_min_W", "P_a_max_W", "P_a_avg_W", "P_b_min_W", "P_b_max_W", "P_b_avg_W",
    "P_c_min_W", "P_c_max_W", "P_c_avg_W", "P_total_min_W", "P_total_max_W", "P_total_avg_W",
    "S_a_min_VA", "S_a_max_VA", "S_a_avg_VA", "S_b_min_VA", "S_b_max_VA", "S_b_avg_VA",
    "S_c_min_VA", "S_c_max_VA", "S_c_avg_VA", "S_total_min_VA", "S_total_max_VA", "S_total_avg_VA",
    "Q_a_min_VAR", "Q_a_max_VAR", "Q_a_avg_VAR", "Q_b_min_VAR", "Q_b_max_VAR", "Q_b_avg_VAR",
    "Q_c_min_VAR", "Q_c_max_VAR", "Q_c_avg_VAR", "Q_total_min_VAR", "Q_total_max_VAR", "Q_total_avg_VAR",
    "P1_a_min_W", "P1_a_max_W", "P1_a_avg_W", "P1_b_min_W", "P1_b_max_W", "P1_b_avg_W",
    "P1_c_min_W", "P1_c_max_W", "P1_c_avg_W", "P1_total_min_W", "P1_total_max_W", "P1_total_avg_W",
    "S1_a_min_VA", "S1_a_max_VA", "S1_a_avg_VA", "S1_b_min_VA", "S1_b_max_VA", "S1_b_avg_VA",
    "S1_c_min_VA", "S1_c_max_VA", "S1_c_avg_VA", "S1_total_min_VA", "S1_total_max_VA", "S1_total_avg_VA",
    "Q1_a_min_VAR", "Q1_a_max_VAR", "Q1_a_avg_VAR", "Q1_b_min_VAR", "Q1_b_max_VAR", "Q1_b_avg_VAR",
    "Q1_c_min_VAR", "Q1_c_max_VAR", "Q1_c_avg_VAR", "Q1_total_min_VAR", "Q1_total_max_VAR", "Q1_total_avg_VAR",
    "PF_a_min", "PF_a_max", "PF_a_avg", "PF_b_min", "PF_b_max", "PF_b_avg",
    "PF_c_min", "PF_c_max", "PF_c_avg", "PF_total_min", "PF_total_max", "PF_total_avg",
    "DPF_a_min", "DPF_a_max", "DPF_a_avg", "DPF_b_min", "DPF_b_max", "DPF_b_avg",
    "DPF_c_min", "DPF_c_max", "DPF_c_avg", "DPF_total_min", "DPF_total_max", "DPF_total_avg",
    "Wh_a", "Wh_b", "Wh_c", "Wh_total",
    "VAh_a", "VAh_b", "VAh_c", "VAh_total",
    "VARh_a", "VARh_b", "VARh_c", "VARh_total",
    "loss_or_demand_156", "energy_reverse_total_157", "reserved_158", "reserved_159",
    "reserved_160", "reserved_161", "reserved_162", "reserved_163",
]
# Fixed values of the file format: from index 170 on; 164 to 169 have no name.
_LAST = [
    "V_LN_rolling_all_V", "I_rolling_all_A", "V_LN_a_rolling_V", "I_a_rolling_A", "V_LN_b_rolling_V",
    "I_b_rolling_A", "V_LN_c_rolling_V", "I_c_rolling_A", "V_LN_rolling_178_V", "I_rolling_179_A",
]

#: Channel name by float index.
CHANNELS = dict(enumerate(_FIRST)) | dict(enumerate(_LAST, 170))
INDEX = {name: i for i, name in CHANNELS.items()}

#: Channels that the analyses use.
CORE = (
    [f"V_LN_{p}_{s}_V" for s in STATS for p in PHASES]
    + [f"I_{p}_{s}_A" for s in ("max", "avg") for p in PHASES]
    + ["freq_avg_Hz", "P_total_avg_W", "S_total_avg_VA", "Q_total_avg_VAR", "PF_total_avg", "DPF_total_avg", "Wh_total"]
    + [f"{q}_THD_pct_{p}_avg" for q in "VI" for p in PHASES]
)
#: Columns of the slim table that workbooks and bundles carry.
SLIM = ["t_start", *(f"V_LN_{p}_avg_V" for p in PHASES), *(f"I_{p}_avg_A" for p in PHASES), "freq_avg_Hz", "P_total_avg_W", "S_total_avg_VA", "Q_total_avg_VAR", "PF_total_avg", "Wh_total", *(f"{q}_THD_pct_{p}_avg" for q in "VI" for p in PHASES)]

_SIGNED = ("P_", "P1_", "Q_", "Q1_", "PF_", "DPF_", "Wh_", "VARh_")


def reversed_channels(phases: str | list[str] | None) -> list[str]:
    """Channels whose sign turns when the current transformers of these phases are the wrong way round; totals always do."""
    chosen = parse_phases(phases)
    if not chosen:
        return []
    parts = {*chosen, "total"}
    return [n for n in INDEX if n.startswith(_SIGNED) and n.split("_")[1] in parts]


def parse_phases(text: str | list[str] | None) -> list[str]:
    """``None``, ``all``, ``a,c`` or a list; anything else raises."""
    if not text:
        return []
    if text == "all":
        return list(PHASES)
    found = [x.strip().lower() for x in (text.split(",") if isinstance(text, str) else text) if x.strip()]
    if bad := [x for x in found if x not in PHASES]:
        raise ValueError(f"no such phase: {', '.join(bad)}")
    return sorted(set(found))


def record_schema(columns: list[str] | None = None) -> T.StructType:
    """``record_index, t_start, t_end`` and the channels, as FLOAT."""
    head = [T.StructField("record_index", T.LongType()), T.StructField("t_start", T.TimestampType()), T.StructField("t_end", T.TimestampType())]
    return T.StructType(head + [T.StructField(n, T.FloatType()) for n in (columns or CHANNELS.values())])
