"""Schemas of the relations that the operators take and give."""

def ladder(depth: int = 10) -> str:
    """DDL of wide book columns: price and size of each side and level."""
    return ", ".join(f"{side}_{what}_{k:02d} double" for side in ("bid", "ask") for what in ("px", "sz") for k in range(depth))


MESSAGES = "time double, event_type int, order_id long, size long, price long, direction int"
L1_BOOK = "timestamp double, bid_px_0 long, bid_sz_0 long, ask_px_0 long, ask_sz_0 long"
PRINTS = "symbol string, date date, sec long, price double, size double, sign double, sequence long"
BARS = "sec long, signed_vol double, volume double, mid double"
OFI_BARS = "sec long, ofi_best double, ofi_sum double, ofi_integrated double"
FILL_RUNS = "sign double, shares double, n_fills long, t_start double, t_end double, mid_start double, mid_end double"
BOOKWALK_BINS = "session string, side string, size_normalisation string, size double, n long, cost_bp double, cost_sigma double, cost_half_spreads double, cost_sd double, participating double"
DAILY = "permno long, date date, ret double, volume double, price double"
NAMES = "ticker string, permno long, namedt date, nameendt date, shrcd int, exchcd int"
UNIVERSE = "symbol string, relative_tick double, dollar_volume double"
