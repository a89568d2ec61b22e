"""The registered queries: plans over the tables of a data folder, with their SQL."""
