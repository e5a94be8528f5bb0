from churnlens.cli import main

main()
