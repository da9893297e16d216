"""Writers: topics, keyed upserts, replacing marts and JDBC tables."""
