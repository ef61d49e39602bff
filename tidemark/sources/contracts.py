"""Field contracts of the ingested datasets and their accepted column names."""

from __future__ import annotations

# Canonical columns and types.
COLUMNS: dict[str, dict[str, str]] = {
    "trading_calendar": {
        "trade_date": "date", "is_open": "bool", "prev_trade_date": "date", "next_trade_date": "date", "source": "string",
    },
    "securities": {
        "stock_code": "code", "stock_name": "string", "exchange": "string", "list_date": "date", "delist_date": "date",
        "delist_publish_time": "timestamp", "delist_effective_date": "date", "source": "string",
    },
    "universe_members": {
        "index_code": "index", "stock_code": "code", "in_date": "date", "out_date": "date", "in_publish_time": "timestamp",
        "in_effective_date": "date", "out_publish_time": "timestamp", "out_effective_date": "date", "source": "string",
        "source_tag": "string", "universe_kind": "string",
    },
    "daily_prices": {
        "stock_code": "code", "trade_date": "date", "open": "double", "high": "double", "low": "double", "close": "double",
        "volume": "long", "amount": "double", "adj_factor": "double", "is_suspended": "bool", "limit_up": "double",
        "limit_down": "double", "source": "string",
    },
    "valuation_daily": {
        "stock_code": "code", "trade_date": "date", "pe_ttm": "double", "pb": "double", "ps": "double",
        "dividend_yield": "double", "total_mv": "double", "float_mv": "double", "source": "string",
    },
}

# Columns that must be present and filled.
REQUIRED: dict[str, list[str]] = {
    "trading_calendar": ["trade_date", "is_open", "source"],
    "securities": ["stock_code", "exchange", "list_date", "source"],
    "universe_members": ["index_code", "stock_code", "in_date", "in_effective_date", "source", "source_tag", "universe_kind"],
    "daily_prices": ["stock_code", "trade_date", "open", "high", "low", "close", "volume", "amount"],
    "valuation_daily": ["stock_code", "trade_date", "pe_ttm", "pb", "source"],
}

# Unique keys.
KEYS: dict[str, list[str]] = {
    "trading_calendar": ["source", "trade_date"],
    "securities": ["source", "stock_code"],
    "universe_members": ["source_tag", "index_code", "stock_code", "in_date"],
    "daily_prices": ["source", "stock_code", "trade_date"],
    "valuation_daily": ["source", "stock_code", "trade_date"],
}

# Accepted names per canonical column, compared without case, spaces and hyphens.
ALIASES: dict[str, dict[str, list[str]]] = {
    "trading_calendar": {
        "trade_date": ["trade_date", "tradedate", "cal_date", "date", "日期", "交易日期"],
        "is_open": ["is_open", "isopen", "是否交易"],
        "prev_trade_date": ["prev_trade_date", "pretrade_date"],
        "next_trade_date": ["next_trade_date"],
        "source": ["source", "source_tag"],
    },
    "securities": {
        "stock_code": ["stock_code", "stockcode", "symbol", "code", "证券代码", "股票代码", "成分券代码", "品种代码"],
        "stock_name": ["stock_name", "stockname", "name", "证券简称", "股票简称", "成分券名称", "名称"],
        "exchange": ["exchange", "交易所"],
        "list_date": ["list_date", "上市日期"],
        "delist_date": ["delist_date", "退市日期"],
        "delist_publish_time": ["delist_publish_time"],
        "delist_effective_date": ["delist_effective_date"],
        "source": ["source", "source_tag"],
    },
    "universe_members": {
        "index_code": ["index_code", "indexcode", "指数代码"],
        "stock_code": ["stock_code", "stockcode", "symbol", "code", "成分券代码", "品种代码", "证券代码", "股票代码"],
        "in_date": ["in_date", "纳入日期"],
        "out_date": ["out_date", "剔除日期"],
        "in_publish_time": ["in_publish_time"],
        "in_effective_date": ["in_effective_date"],
        "out_publish_time": ["out_publish_time"],
        "out_effective_date": ["out_effective_date"],
        "source": ["source"],
        "source_tag": ["source_tag"],
        "universe_kind": ["universe_kind", "universe_mode"],
    },
    "daily_prices": {
        "stock_code": ["stock_code", "stockcode", "symbol", "code", "股票代码", "证券代码"],
        "trade_date": ["trade_date", "tradedate", "date", "日期"],
        "open": ["开盘", "开盘价", "open"],
        "high": ["最高", "最高价", "high"],
        "low": ["最低", "最低价", "low"],
        "close": ["收盘", "收盘价", "close"],
        "volume": ["成交量", "volume"],
        "amount": ["成交额", "amount"],
        "adj_factor": ["adj_factor", "复权因子"],
        "is_suspended": ["is_suspended", "停牌"],
        "limit_up": ["limit_up", "涨停"],
        "limit_down": ["limit_down", "跌停"],
        "source": ["source", "source_tag"],
    },
    "valuation_daily": {
        "stock_code": ["stock_code", "stockcode", "symbol", "code", "股票代码", "证券代码"],
        "trade_date": ["trade_date", "tradedate", "date", "日期"],
        "pe_ttm": ["pe_ttm", "市盈率ttm"],
        "pb": ["pb", "市净率"],
        "ps": ["ps", "市销率"],
        "dividend_yield": ["dividend_yield", "股息率"],
        "total_mv": ["total_mv", "总市值"],
        "float_mv": ["float_mv", "流通市值"],
        "source": ["source"],
    },
}
