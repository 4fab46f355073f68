"""txnlens: fraud analytics and document retrieval as Spark DataFrame plans."""
