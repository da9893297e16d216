"""The layered warehouse: detail (dwd), middle (dwm), service (dws) and serving queries."""
