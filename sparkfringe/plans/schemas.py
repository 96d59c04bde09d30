"""Schemas of the tables; one row of visibilities is one row and channel of a measurement set."""

CPLX = "struct<re:double,im:double>"
JONES = f"array<{CPLX}>"
KEYS = ("scan", "field", "ddid")
CHUNK = (*KEYS, "t_chunk", "f_chunk")

VIS = f"""scan int, field int, ddid int, row_id bigint, time double, interval double, ant1 int, ant2 int,
u double, v double, w double, chan int, freq double, width double, data {JONES}, model array<{JONES}>,
weight array<double>, flag array<boolean>, flag_row boolean"""
ANTENNA = "ant int, name string, mount string, x double, y double, z double, flag_row boolean"
SPECTRAL_WINDOW = "spw int, chan_freq array<double>, chan_width array<double>, ref_frequency double, total_bandwidth double"
POLARIZATION = "pol int, corr_type array<int>"
DATA_DESCRIPTION = "ddid int, spw int, pol int"
FIELD = "field int, name string, source_id int, phase_ra double, phase_dec double"
FEED = "ant int, spw int, pol_type array<string>, receptor_angle array<double>"
GAIN = f"""term string, type string, scan int, field int, ddid int, t_chunk int, f_chunk int, t_bin int, f_bin int,
gain_time double, gain_freq double, ant int, dir int, g {JONES}, gain_flag byte"""
PARAM = """term string, type string, scan int, field int, ddid int, t_chunk int, f_chunk int, t_bin int, f_bin int,
param_time double, param_freq double, ant int, dir int, p array<double>, param_flag byte"""
SOURCES = """model string, cluster string, type string, ra double, dec double, i double, q double, u double, v double,
spi double, ref_freq double, emaj double, emin double, pa double"""

SUB_TABLES = {
    "ANTENNA": ANTENNA, "SPECTRAL_WINDOW": SPECTRAL_WINDOW, "POLARIZATION": POLARIZATION,
    "DATA_DESCRIPTION": DATA_DESCRIPTION, "FIELD": FIELD, "FEED": FEED,
}
