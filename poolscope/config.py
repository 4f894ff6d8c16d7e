"""Settings and fixed values.

Addresses, event hashes and defaults below are facts of the chain and of the published boards:
changing one changes results, so they are stated as plain values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: currencies (all 18 decimals) ---
NATIVE_COIN = "0x0000000000000000000000000000000000000000"
WBNB = "0xbb4cdb9cbd36b01bd1cbaebf2de08d9173bc095c"
USDT = "0x55d398326f99059ff775485246999027b3197955"
USDC = "0x8ac76a51cc950d9822d68b83fe1ad97b32cd580d"
USD1 = "0x8d0d000ee44948fc98c9b98a4fa4921476f08b0d"
ZERO_ADDRESS = NATIVE_COIN
ANCHOR_DECIMALS = 18

# --- fixed values: anchor currency -> kind ('usd' is already dollars, 'bnb' needs a rate) ---
ANCHORS = {
    NATIVE_COIN: "bnb",
    WBNB: "bnb",
    USDT: "usd",
    USDC: "usd",
    USD1: "usd",
}

# --- fixed values: anchor -> board, and the boards in publishing order ---
BOARD_BY_ANCHOR = {NATIVE_COIN: "wbnb", WBNB: "wbnb", USDT: "usdt"}
BOARD_LABELS = {
    "wbnb": "PancakeSwap v3 (WBNB pairs)",
    "usdt": "PancakeSwap v3 (USDT pairs)",
}
CL_BOARD = "cl"
CL_LABEL = "PancakeSwap Infinity"

# --- fixed values: fee tier (pips) -> tick spacing ---
TICK_SPACING = {100: 1, 500: 10, 2500: 50, 10000: 200}

# --- fixed values: symbol -> (address, decimals) ---
TOKEN_ALIASES = {
    "WBNB": (WBNB, 18),
    "USDT": (USDT, 18),
    "USDC": (USDC, 18),
    "USD1": (USD1, 18),
    "BUSD": ("0xe9e7cea3dedca5984780bafc599bd69add087d56", 18),
    "BTCB": ("0x7130d2a12b9bcbfae4f2634d864a1ee1ce3ead9c", 18),
    "ETH": ("0x2170ed0880ac9a755fd29b2688956bd959f933f8", 18),
    "CAKE": ("0x0e09fabb73bd3ade0a17ecc321fd13a19e81ce82", 18),
}

# --- fixed values: tokens kept off the boards, by address, in three groups ---
DENIED_STABLECOINS = (
    "0x55d398326f99059ff775485246999027b3197955",  # USDT
    "0x8ac76a51cc950d9822d68b83fe1ad97b32cd580d",  # USDC
    "0x8d0d000ee44948fc98c9b98a4fa4921476f08b0d",  # USD1
    "0xe9e7cea3dedca5984780bafc599bd69add087d56",  # BUSD
    "0xc5f0f7b66764f6ec8c8dff7ba683102295e16409",  # FDUSD
    "0x1af3f329e8be154074d8769d1ffa4ee058b1dbc3",  # DAI
    "0x14016e85a25aeb13065688cafb43044c2ef86784",  # TUSD
    "0x5c7f8a570d578ed84e63fdfa7b1ee72deae1ae23",  # wUSDR
    "0xd17479997f34dd9156deef8f95a52d81d265be9c",  # USDD
    "0x3f56e0c36d275367b8c502090edf38289b3dea0d",  # MAI
)
DENIED_WRAPPED = (
    "0x7130d2a12b9bcbfae4f2634d864a1ee1ce3ead9c",  # BTCB
    "0x2170ed0880ac9a755fd29b2688956bd959f933f8",  # ETH
    "0x4db5a66e937a9f4473fa95b1caf1d1e1d62e29ea",  # WETH
    "0xfb6115445bff7b52feb98650c87f44907e58f802",  # AAVE
    "0x1d2f0da169ceb9fc7b3144628db156f3f6c60dbe",  # XRP
    "0x3ee2200efb3400fabb9aacf31297cbdd1d435d47",  # ADA
    "0x570a5d26f7765ecb712c0924e4de545b89fd43df",  # SOL
    "0xba2ae424d960c26247dd6c32edc70b295c744c43",  # DOGE
    "0x7083609fce4d1d8dc0c979aab8c869ea2c873402",  # DOT
    "0xcf6bb5389c92bdda8a3747ddb454cb7a64626c63",  # XVS
)
DENIED_DEFI = (
    "0x0e09fabb73bd3ade0a17ecc321fd13a19e81ce82",  # CAKE
    "0x52ce071bd9b1c4b00a0b92d298c512478cad67e8",  # COMP
    "0xf8a0bf9cf54bb92f17374d9e9a321e6a111a51bd",  # LINK
    "0xbf5140a22578168fd562dccf235e5d43a02ce9b1",  # UNI
    "0x947950bcc74888a40ffa2593c5798f11fc9124c4",  # SUSHI
    "0x111111111117dc0aa78b770fa6a738034120c302",  # 1INCH
    "0x88f1a5ae2a3bf98aeaf342d26b30a79438c9142e",  # YFI
    "0x156ab3346823b651294766e23e6cf87254d68962",  # LUNA
    "0xa2120b9e674d3fc3875f415a7df52e382f141225",  # ATA
    "0xfd7b3a77848f1c2d67e05e54d78d174a0c850335",  # ONT
)

# --- fixed values: well-known contracts and the block explorer used in report links ---
POSITION_MANAGER = "0x46a15b0b27311cedf172ab29e4f4766fbe7f4364"
EXPLORER_TOKEN_URL = "https://bscscan.com/token/"

# --- fixed values: tick bounds of the 1.0001^tick price grid ---
MIN_TICK = -887272
MAX_TICK = 887272

MAX_MESSAGE_UNITS = 4096  # hard limit of one rendered board, in UTF-16 units


@dataclass(frozen=True)
class VenueConfig:
    """Where a venue's swap events come from and how its pools behave."""

    name: str
    swap_topic0: str
    log_addresses: tuple[str, ...] | None = None  # None: the pool set is found in the logs
    registry: str | None = None
    rank_by: str = "swaps"
    routed: bool = True  # split into boards by anchor, or publish one board


# --- fixed values: event hashes and contract addresses per venue ---
V3 = VenueConfig(
    name="v3",
    swap_topic0="0x19b47279256b2a23a1665c810c8d55a1758940ee09377d4f8d26497a3577dc83",
    registry="0x0bfbcf9fa4f9c56b0f40a671ad40e0805a091865",
)
CL = VenueConfig(
    name="cl",
    swap_topic0="0x04206ad2b7c0f463bff3dd4f33c5735b0f2957a351e4f79763a4fa9e775dd237",
    log_addresses=("0xa0ffb9c1ce1fe56963b0321b32e7a0302114058b",),
    rank_by="spike",
    routed=False,
)
RATE_POOL = "0x172fcd41e0913e95784454622d1c3724f546f849"


@dataclass(frozen=True)
class BoardConfig:
    """Tunable numbers of a board run.

    The defaults are the published ones, without the two limits of a single live process: how many
    tokens a board may look up and how many pools are tracked (see `live_config`).
    """

    blocks_per_bucket: int = 667
    lookback_blocks: int = 300
    rows_per_group: int = 8
    min_market_cap_usd: float = 300_000.0
    max_lookups: int | None = None
    rsi_min_volume: int = 0
    history_buckets: int = 24
    retained_closes: int = 30
    tracked_pools: int | None = None
    spike_min_buckets: int = 3
    spike_floor_usd18: int = 50 * 10**18
    spike_ceiling: float = 999.0
    max_fee_pips: int = 100_000
    deny_extra: tuple[str, ...] = field(default_factory=tuple)
    deny_allow: tuple[str, ...] = field(default_factory=tuple)
    deny_enabled: bool = True


def live_config(**changes) -> BoardConfig:
    """The published limits of a live process: 40 lookups a board, the newest 500 pools tracked."""
    return BoardConfig(**{"max_lookups": 40, "tracked_pools": 500, **changes})


# How long an answer stays fresh, in milliseconds (None: for ever).
RATE_TTL_MS = 60_000
SUPPLY_TTL_MS = 3_600_000
UNVERIFIED_TTL_MS = 6 * 3_600_000
UNRESOLVED_TTL_MS = 24 * 3_600_000
