"""Declared schemas of raw payloads and of facts tables. Nothing is inferred."""

from __future__ import annotations

#: Rows of paged JSON envelopes ``{"results": [...]}``.
TICKERS = "ticker string, name string, market string, locale string, primary_exchange string, type string, active boolean, currency_name string, cik string, composite_figi string, share_class_figi string, delisted_utc string, last_updated_utc string"
EXCHANGES = "id string, type string, asset_class string, locale string, name string, mic string, operating_mic string"
SPLITS = "id string, ticker string, execution_date string, split_from double, split_to double"
DIVIDENDS = "id string, ticker string, ex_dividend_date string, cash_amount double, currency string, declaration_date string, dividend_type string, frequency int, pay_date string, record_date string"
GROUPED_DAILY = "T string, o double, h double, l double, c double, v double, vw double, n long"
#: One object with a nested array, and a top-level array.
TICKER_EVENTS = "results struct<composite_figi: string, events: array<struct<ticker_change: struct<ticker: string>, type: string, date: string>>>"
HOLIDAYS = "exchange string, name string, date string, status string, open string, close string"
#: Minute files.
MINUTE_CSV = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
MINUTES = "market_date date, symbol string, window_start_utc timestamp, open double, high double, low double, close double, volume double, transactions long"
MANIFEST = "fetch_id string, run_id string, source_id string, dataset string, request_url string, market_scope string, market_date date, http_status int, file_path string, file_bytes long, content_sha256 string, row_count int, fetched_at timestamp"

#: Facts.
INSTRUMENTS = "instrument_id string, asset_class string, instrument_type string, security_form string, is_clean_common_stock boolean, name string, primary_market_scope string, primary_exchange_mic string, currency string, active boolean, delisted_date date, first_seen_date date"
SYMBOLS = "symbol_id string, instrument_id string, market_scope string, symbol string, exchange_mic string, valid_from date, valid_to date, is_primary boolean, evidence string"
IDENTIFIERS = "identifier_type string, identifier_value string, valid_from date, instrument_id string, source_id string, valid_to date"
BARS_DAILY = "source_id string, instrument_id string, market_date date, market_scope string, symbol_as_traded string, open double, high double, low double, close double, volume double, vwap double, trade_count long"
ACTIONS = "source_id string, source_action_id string, instrument_id string, market_scope string, symbol_as_stated string, action_type string, ex_date date, declaration_date date, record_date date, pay_date date, split_from double, split_to double, cash_amount double, cash_amount_post_tax double, bonus_ratio double, conversion_ratio double, currency string, dividend_type string, frequency int"
TRADING_DAYS = "calendar_id string, market_date date, is_open boolean, is_half_day boolean, open_utc timestamp, close_utc timestamp, source_id string"
EXCHANGE_FACTS = "exchange_mic string, name string, exchange_type string, market_scope string, calendar_id string, timezone string, country string, currency string"
UNRESOLVED = "dataset string, market_scope string, symbol string, market_date date, reason string, sample string"
