"""ledgerloom: statement analytics and corpus operators as Spark plans."""
