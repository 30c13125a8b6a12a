"""Labels that ship with the library."""

from pyspark.sql import DataFrame, SparkSession

# Address, name, type, risk, hub, contract.
BUILTIN_LABELS = [
    ("0xdAC17F958D2ee523a2206206994597C13D831ec7", "Tether USD", "stablecoin", "low", True, True),
    ("0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48", "USD Coin", "stablecoin", "low", True, True),
    ("0xC02aaA39b223FE8D0A0e5C4F27eAD9083C756Cc2", "Wrapped Ether", "token", "none", True, True),
    ("0x6B175474E89094C44Da98b954EedeAC495271d0F", "Dai Stablecoin", "stablecoin", "low", True, True),
    ("0x7a250d5630B4cF539739dF2C5dAcb4c659F2488D", "Uniswap V2 Router", "dex", "low", True, True),
    ("0xE592427A0AEce92De3Edee1F18E0157C05861564", "Uniswap V3 Router", "dex", "low", True, True),
    ("0x2260FAC5E5542a773Aa44fBCfeDf7C193bc2C599", "Wrapped Bitcoin", "wrapped_asset", "low", True, True),
    ("0xae7ab96520DE3A18E5e111B5EaAb095312D7fE84", "Lido Staked Ether", "staking", "low", True, True),
    ("0x514910771AF9Ca656af840dff83E8264EcF986CA", "Chainlink Token", "oracle_token", "low", True, True),
    ("0x9f8F72aA9304c8B593d555F12eF6589cC3A579A2", "Maker", "governance_token", "low", True, True),
]
SCHEMA = "address string, name string, entity_type string, risk_level string, is_hub boolean, is_contract boolean"


def builtin_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN_LABELS, SCHEMA)
